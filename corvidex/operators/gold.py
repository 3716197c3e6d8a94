"""The life of a gold set: candidates from ticket states, checks, splits, imports, snapshots, status.

A gold set is a table ``qid, class, lang, query, ticket, labels, split``; its versions are
folders of one parent, never changed once written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions.text import ENGLISH_STOP_WORDS, POLISH_STOP_WORDS, ascii_fold

CLASSES, LANGUAGES, SPLITS = ("K", "Q", "P", "T", "X"), ("en", "pl", "pl-ascii", "mix"), ("dev", "test")
# fixed values: how a question about each kind of item begins
LEADS = {
    "en": {"decision": "What did we decide about", "blocker": "What is blocking", "next": "What is the next step for"},
    "pl": {"decision": "Co ustaliliśmy w sprawie", "blocker": "Co blokuje", "next": "Jaki jest następny krok dla"},
}
STATE_SCHEMA = "ticket_key string, lifecycle string, phase string, next_action string, updated_at string, decisions array<struct<id:string,status:string,description:string>>, blockers array<struct<status:string,description:string>>"
#: Where marks end a word or statement: punctuation but ``_ - / .``.
_MARKS = r"[\p{P}&&[^_\-\/.]]"


def java_hash(text: Column) -> Column:
    """``String.hashCode`` of the JVM: 31-fold over UTF-16 units, wrapped to 32 bits."""
    units = F.filter(F.split(F.regexp_replace(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), "(.{4})", "$1 "), " "), lambda x: x != "")
    wide = F.aggregate(units, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.conv(x, 16, 10).cast("long"), F.lit(1 << 32)))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)


def split_for(ticket: Column) -> Column:
    """dev for about 70 % of tickets, test for the rest, the same on every run."""
    return F.when(F.abs(java_hash(ticket)) % 10 < 7, "dev").otherwise("test")


def candidates(states: DataFrame, text: str = "text") -> DataFrame:
    """Unlabelled questions from ticket states (JSON): one in words and one of keywords per item.

    Items are decisions, blockers and the next action with at least three words; states
    that are no JSON or have no key are left out. ``qid, class, lang, query, ticket, kind, split``.
    """
    s = states.select(F.from_json(text, STATE_SCHEMA).alias("s")).where("s.ticket_key is not null").select("s.*")
    item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("said"))
    items = F.concat(
        F.transform(F.coalesce("decisions", F.array().cast("array<struct<id:string,status:string,description:string>>")), lambda d: item("decision", d["description"])),
        F.transform(F.coalesce("blockers", F.array().cast("array<struct<status:string,description:string>>")), lambda d: item("blocker", d["description"])),
        F.array(item("next", F.col("next_action"))),
    )
    words = F.slice(F.filter(F.split(F.trim(F.regexp_replace("x.said", r"\s+", " ")), " "), lambda w: w != ""), 1, 10)
    long = F.filter(items, lambda x: F.size(F.filter(F.split(F.coalesce(x["said"], F.lit("")), r"\s+"), lambda w: w != "")) >= 3)
    rows = s.select("ticket_key", F.posexplode(long).alias("n", "x")).withColumn("words", words)
    polish = F.col("x.said").rlike("[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]")
    lead = F.lit(None).cast("string")
    for lang, by_kind in LEADS.items():
        for kind, said in by_kind.items():
            lead = F.when((polish == (lang == "pl")) & (F.col("x.kind") == kind), said).otherwise(lead)
    stop = F.array(*[F.lit(w) for w in sorted({*ENGLISH_STOP_WORDS, *POLISH_STOP_WORDS})])
    keys = F.slice(F.filter("words", lambda w: ~F.array_contains(stop, ascii_fold(F.regexp_replace(w, _MARKS, "")))), 1, 3)
    question = F.concat(lead, F.lit(" "), F.regexp_replace(F.array_join("words", " "), _MARKS + "+$", ""), F.lit("?"))
    forms = F.array(F.struct(F.lit("Q").alias("class"), question.alias("query")), F.struct(F.lit("K").alias("class"), F.array_join(keys, " ").alias("query")))
    rows = rows.withColumn("lang", F.when(polish, "pl").otherwise("en")).select("*", F.inline(forms)).where("query <> ''")
    qid = F.concat(F.lit("c-"), "ticket_key", F.lit("-"), "x.kind", "n", F.lower("class"))
    return rows.select(qid.alias("qid"), "class", "lang", "query", F.col("ticket_key").alias("ticket"), "x.kind", split_for(F.col("ticket_key")).alias("split"))


def import_set(existing: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """The set after an import, and what became of each query (``status``).

    ``added``, ``updated``, ``unchanged``, ``kept``, or ``removed`` (with ``replace``; such rows
    are marked, not dropped). A query that is imported twice counts once, by its last text.
    """
    cols = [c for c in existing.columns if c != "qid"]
    digest = F.xxhash64(*cols)
    new = incoming.groupBy("qid").agg(F.max_by(F.struct(*cols), digest).alias("new"))
    old = existing.select("qid", F.struct(*cols).alias("old"))
    j = old.join(new, "qid", "full")
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed" if replace else "kept").when(F.to_json("old") == F.to_json("new"), "unchanged").otherwise("updated")
    )
    return j.select("qid", status.alias("status"), F.coalesce("new", "old").alias("r")).select("qid", "status", "r.*")


def save_version(gold: DataFrame, folder: str, name: str) -> None:
    """Writes a version; one that exists is an error."""
    gold.write.mode("error").parquet(f"{folder}/gold-{name}")


def restore(spark: SparkSession, folder: str, name: str, new: str) -> DataFrame:
    """Makes an earlier version the newest one, under a new name; nothing is overwritten."""
    save_version(spark.read.parquet(f"{folder}/gold-{name}"), folder, new)
    return spark.read.parquet(f"{folder}/gold-{new}")


def status(gold: DataFrame) -> DataFrame:
    """Questions, those with labels, and how often each grade was given."""
    grades = lambda g: F.sum(F.size(F.filter(F.coalesce("labels", F.array().cast(gold.schema["labels"].dataType)), lambda x: x["rel"] == g)))
    have = F.size(F.coalesce("labels", F.array().cast(gold.schema["labels"].dataType))) > 0
    return gold.agg(F.count(F.lit(1)).alias("questions"), F.count_if(have).alias("labelled"), *[grades(g).alias(f"g{g}") for g in range(4)])
