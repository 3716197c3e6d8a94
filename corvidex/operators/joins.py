"""Joins with a shape of their own: reconciliation, band, labels, merges, anchors, parity."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(turns: DataFrame, journal: DataFrame, tolerance_us: int = 120_000_000) -> DataFrame:
    """Best match of each transcript turn in the journal, first rule that holds wins:

    1. same prompt id; 2. same session and content; 3. same session and user text, and
    times at most ``tolerance_us`` apart.

    Both sides have ``id, prompt_id, session_id, content_hash, user_text, at_us``; ties go
    to the smallest journal id. Rule 3 is a band join: times are cut into buckets as wide as
    the tolerance, and a turn meets its own and the two neighbouring buckets, so the join
    keys stay narrow. Turns without a match have a NULL ``journal_id``; kind is ``exact``
    if contents agree, else ``conflict`` within the tolerance, else ``lag``; ``missing``
    without a match. NULL keys match nothing.
    """
    j = journal.select(F.col("id").alias("journal_id"), "prompt_id", "session_id", F.col("content_hash").alias("j_hash"), F.trim("user_text").alias("ut"), F.col("at_us").alias("j_us"))
    t = turns.select("id", "prompt_id", "session_id", "content_hash", F.trim("user_text").alias("ut"), "at_us")
    out = ["id", "journal_id", "content_hash", "j_hash", "at_us", "j_us"]
    one = t.join(j.drop("session_id", "ut"), "prompt_id").select(*out, F.lit(1).alias("rule"))
    two = t.join(j.drop("prompt_id", "ut").withColumn("content_hash", F.col("j_hash")), ["session_id", "content_hash"]).select(*out, F.lit(2).alias("rule"))
    width = F.lit(max(1, tolerance_us))
    left = t.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at_us") / width) + d)))
    right = j.withColumn("bucket", F.floor(F.col("j_us") / width)).drop("prompt_id")
    three = left.join(right, ["session_id", "ut", "bucket"]).where(F.abs(F.col("at_us") - F.col("j_us")) <= tolerance_us).select(*out, F.lit(3).alias("rule"))
    pick = F.min_by(F.struct("journal_id", "j_hash", "j_us", "rule"), F.struct("rule", "journal_id"))
    best = one.unionByName(two).unionByName(three).groupBy("id").agg(pick.alias("m"))
    rows = turns.select("id", "content_hash", "at_us").join(best, "id", "left")
    near = F.abs(F.col("at_us") - F.col("m.j_us")) <= tolerance_us
    kind = (
        F.when(F.col("m").isNull(), "missing")
        .when(F.col("m.j_hash").eqNullSafe(F.col("content_hash")), "exact")
        .when(F.coalesce(near, F.lit(False)), "conflict")
        .otherwise("lag")
    )
    return rows.select("id", "m.journal_id", "m.rule", kind.alias("kind"))


def merge_by_key(old: DataFrame, new: DataFrame, key: str, fields: list[str], keep_others: bool = True) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key.

    ``status`` is added, replaced, kept (or dropped, if others are not kept, in which case
    the row is left out). Keys must be unique on both sides.
    """
    a, b = old.select(key, *fields).withColumn("__a", F.lit(True)), new.select(key, *fields).withColumn("__b", F.lit(True))
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    status = F.when(F.col("__b").isNull(), "kept").when(F.col("__a").isNull(), "added").otherwise("replaced")
    picked = [F.when(F.col("__b"), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields]
    out = j.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *picked, status.alias("status"))
    return out if keep_others else out.where("status <> 'kept'")


def coalesce_upsert(old: DataFrame, new: DataFrame, key: str, replace: list[str], keep_if_null: list[str]) -> DataFrame:
    """Upsert in which some fields keep their old value where the new one is NULL."""
    j = old.alias("a").join(new.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    fresh = F.col(f"b.{key}").isNotNull()
    cols = [F.when(fresh, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in replace]
    cols += [F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f) for f in keep_if_null]
    return j.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *cols)


#: Patterns that one pass over the texts looks for.
PATTERNS_PER_PASS = 5_000


def anchored_facts(texts: DataFrame, anchors: DataFrame, id_column: str, text: str) -> DataFrame:
    """(``id``, ``fact``) where a text matches all patterns of a fact.

    ``anchors`` (``fact``, ``pattern``) becomes one expression, so texts are scanned once and
    no rows are paired; of more than ``PATTERNS_PER_PASS`` patterns the facts are spread over
    several passes.
    """
    passes = max(1, -(-anchors.count() // PATTERNS_PER_PASS))
    out = texts.limit(0).select(id_column, F.lit("").alias("fact"))
    for i in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("fact"), F.lit(passes)) == i)
        by: dict[str, list[str]] = {}
        for r in own.select("fact", "pattern").collect():
            by.setdefault(r.fact, []).append(r.pattern)
        if by:
            out = out.unionByName(_facts_of(texts, by, id_column, text))
    return out


def _facts_of(texts: DataFrame, by: dict[str, list[str]], id_column: str, text: str) -> DataFrame:
    holds = lambda patterns: functools.reduce(lambda a, b: a & b, [F.col(text).rlike(p) for p in patterns])
    flags = [F.when(holds(patterns), F.lit(fact)) for fact, patterns in sorted(by.items())]
    return texts.select(id_column, F.explode(F.filter(F.array(*flags), lambda f: f.isNotNull())).alias("fact"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the surplus (positive: in ``a``).

    One grouped count instead of two set differences; NULLs are equal to NULLs.
    """
    cols = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*cols).withColumn("__n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def first_mismatch(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """Smallest position at which two sequences differ (one row, NULL if they agree)."""
    j = a.select(position, F.col(value).alias("x")).join(b.select(position, F.col(value).alias("y")), position, "full")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.min(position).alias("first_mismatch"))


def newest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
