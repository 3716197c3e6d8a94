"""Passages of documents: sections first, then windows; and the choice of those worth scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions.text import ascii_fold, front_matter_map, strip_front_matter
from corvidex.operators.timestamps import let

WINDOW, STRIDE, MAX_CHARS = 900, 675, 3900
# fixed values: headings of turns and of ticket states (lines end at line feeds)
_TURN_HEAD = r"(?md)^## (User|Assistant|Details)\s*$"
_STATE_HEAD = r"(?md)^## (.+)$"


def _sections(body: Column, head: str, before: str, name) -> Column:
    """``name, start, text`` of the parts of ``body`` that begin with a heading.

    The text is cut before every heading at once; where a part begins is the sum of the
    lengths before it. Without headings the whole body is one section named ``before``.
    """

    def of(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            begin = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.char_length(p))
            line = F.regexp_extract(part, head, 0)
            headed = F.startswith(part, F.lit("## ")) & (line != "")
            skip = F.when(headed, F.char_length(line)).otherwise(0)
            return F.struct(
                F.when(headed, name(F.regexp_extract(part, head, 1))).otherwise(F.lit(before)).alias("section"),
                (begin + skip).alias("at"),
                F.substring(part, skip + 1, F.char_length(part)).alias("part"),
                headed.alias("headed"),
            )

        return F.transform(parts, one)

    cut = head.replace("(?md)", "").replace("(User|Assistant|Details)", "(?:User|Assistant|Details)").replace("(.+)", ".+")
    return let(F.split(body, f"(?md)(?={cut})"), of)


def sections(source: Column, body: Column) -> Column:
    """Sections of a document by the kind of its archive; text before the first heading of a turn is left out."""
    turns = _sections(body, _TURN_HEAD, "turn", F.lower)
    some = lambda xs: F.exists(xs, lambda x: x["headed"])
    turns = let(turns, lambda xs: F.when(some(xs), F.filter(xs, lambda x: x["headed"])).otherwise(xs))
    states = _sections(body, _STATE_HEAD, "state", lambda h: F.concat(F.lit("state-"), F.regexp_replace(F.lower(F.trim(h)), "[^a-z0-9]+", "-")))
    plain = F.array(F.struct(F.lit("chunk").alias("section"), F.lit(0).alias("at"), body.alias("part"), F.lit(False).alias("headed")))
    return F.when(source == "chat:turns", turns).when(source == "worklog:state", states).otherwise(plain)


def structured_passages(docs: DataFrame, body: str = "text", meta: str = "content") -> DataFrame:
    """``doc_id, passage_id, section, char_start, char_end, n_tokens, passage`` of all documents.

    Sections are cut into windows of ``WINDOW`` characters, one every ``STRIDE``; blank ones
    are left out. A passage begins with a line that says ticket, date, mode and section, and
    ends at ``MAX_CHARS``. Its id is a digest of place and span. NULL and empty bodies have none.
    """
    rows = docs.where(F.length(body) > 0).select("doc_id", "origin_db", "source", "file_path", strip_front_matter(F.col(body)).alias("body"), front_matter_map(F.col(meta)).alias("m"))
    rows = rows.select("*", F.inline(sections(F.col("source"), F.col("body")))).drop("body", "headed")
    n = F.char_length("part")
    last = F.greatest(F.lit(0), F.ceil((n - WINDOW) / F.lit(STRIDE)).cast("int"))
    rows = rows.where(F.trim(F.regexp_replace("part", r"\s+", " ")) != "").withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring(F.col("part"), F.col("i") * STRIDE + 1, F.lit(WINDOW))
    start, end = F.col("at") + F.col("i") * STRIDE, F.col("at") + F.least(F.col("i") * STRIDE + WINDOW, n)
    ticket = F.get(F.filter(F.split("file_path", "/"), lambda p: p.rlike("^[a-z]+[0-9]+$")), F.lit(0))
    stamp = F.col("m")["timestamp"]
    said = F.concat_ws(
        " ",
        F.concat(F.lit("ticket="), ticket),
        F.when(F.length(stamp) >= 10, F.concat(F.lit("date="), F.substring(stamp, 1, 10))),
        F.when(F.col("m")["mode"] != "", F.concat(F.lit("mode="), F.col("m")["mode"])),
        F.concat(F.lit("section="), F.col("section")),
    )
    shown = F.substring(F.concat(said, F.lit("\n"), piece), 1, MAX_CHARS)
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("null")) for c in ("origin_db", "source", "file_path")], "section", start, end)
    out = rows.where(F.trim(F.regexp_replace(piece, r"\s+", " ")) != "")
    return out.select(
        "doc_id", F.substring(F.sha1(key), 1, 16).alias("passage_id"), "section", start.alias("char_start"), end.alias("char_end"),
        F.floor((F.char_length(shown) + 3) / 4).cast("int").alias("n_tokens"), shown.alias("passage"),
    )


def words_of(c: Column) -> Column:
    """Distinct folded words of a passage."""
    return F.array_distinct(F.regexp_extract_all(ascii_fold(c), F.lit(r"([a-z0-9_]+)")))


def best_passages(passages: DataFrame, words: list[str], most: int = 3) -> DataFrame:
    """The ``most`` passages of each document that share most query words, in document order.

    A document of at most ``most`` passages keeps all; one that shares no word keeps its
    first passage. Adds ``found`` (words shared).
    """
    wanted = sorted(set(words))
    found = F.size(F.array_intersect(words_of(F.col("passage")), F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
    own = Window.partitionBy("doc_id")
    order = own.orderBy(F.col("found").desc(), "char_start", "passage_id")
    rows = passages.withColumn("found", found).withColumns({"r": F.row_number().over(order), "n": F.count(F.lit(1)).over(own), "top": F.max("found").over(own)})
    keep = (F.col("n") <= most) | ((F.col("found") > 0) & (F.col("r") <= most)) | ((F.col("top") == 0) & (F.col("r") == 1))
    return rows.where(keep).drop("r", "n", "top")
