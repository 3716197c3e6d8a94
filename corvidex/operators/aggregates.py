"""Aggregates: manifests, listings, stamps, dominance, summaries and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Groups and a grand total in one pass (the total has NULL keys)."""
    sets = [[F.col(k) for k in keys], []]
    return df.groupingSets(sets, *keys).agg(*aggs)


def manifest_state(docs: DataFrame) -> DataFrame:
    """Live and compressed documents per archive and their state."""
    g = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("is_compressed") == 1).alias("compressed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes")
    )
    state = (
        F.when(F.col("docs") == F.col("compressed"), "compressed")
        .when(F.col("compressed") > 0, F.format_string("hybrid (%d/%d)", "compressed", "docs"))
        .otherwise("uncompressed")
    )
    return g.withColumn("state", state)


def source_identity(rows: DataFrame, first_seen: str = "recorded_at") -> DataFrame:
    return rows.groupBy("source_identity").agg(F.min(first_seen).alias("first_seen"), F.max(first_seen).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def conflicts(rows: DataFrame, key: str = "logical_turn_key", value: str = "content_hash") -> DataFrame:
    """Keys with more than one distinct value; blank keys are left out."""
    g = rows.where(F.trim(key) != "").groupBy(key).agg(F.count_distinct(value).alias("variants"), F.count(F.lit(1)).alias("n"))
    return g.where("variants > 1")


def dominant(rows: DataFrame, group: list[str], value: str, share: float, strict: bool = True) -> DataFrame:
    """Most frequent value per group if it holds more than (or at least, if not ``strict``) ``share``.

    Ties go to the smallest value. Counting is done before the groups are formed, so one
    hot value costs nothing.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("t"), F.sum("n").alias("total"))
    enough = F.col("t.n") > share * F.col("total") if strict else F.col("t.n") >= F.ceil(share * F.col("total"))
    return top.where(enough & F.col(f"t.{value}").isNotNull()).select(*group, F.col(f"t.{value}").alias(value), F.col("t.n").alias("n"), "total")


def nearest_rank(value: str, share: float, rule: str = "ceil") -> Column:
    """Percentile as an existing value; ``ceil``: round(share*n + 0.5), ``index``: round(share*(n-1)) + 1.

    Exact, from counts of distinct values in order: see ``percentile_nearest``.
    """
    n = F.count(value)
    place = F.round(share * n + 0.5) if rule == "ceil" else F.bround(share * (n - 1)) + 1
    return F.greatest(F.lit(1), F.least(n, place.cast("long")))


def percentile_nearest(df: DataFrame, group: list[str], value: str, share: float, rule: str = "ceil") -> DataFrame:
    """Nearest-rank percentile per group, without gathering a group.

    Rows are reduced to counts per distinct value; running counts then find the value at
    the rank. NULLs are ignored; a group of only NULLs has no row.
    """
    from pyspark.sql import Window

    if not group:
        one = percentile_nearest(df.withColumn("__all", F.lit(0)), ["__all"], value, share, rule)
        return one.drop("__all")
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    ranks = df.groupBy(*group).agg(nearest_rank(value, share, rule).alias("__rank"))
    up_to = F.sum("__c").over(Window.partitionBy(*group).orderBy(value))
    run = counts.withColumn("__up", up_to)
    return run.join(ranks, group).where(F.col("__up") >= F.col("__rank")).groupBy(*group).agg(F.min(value).alias("percentile"))
