"""Row numbers over groups of any size.

A window over a key keeps a whole group in one task. Where a group may hold a large part
of all rows, the numbers are made in blocks: rows are range-partitioned by key and order,
numbered inside each block, and shifted by the counts of the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.session import cut_lineage


def blocked_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str = "row_number") -> DataFrame:
    """Adds ``out``: 1, 2, ... per group of ``keys`` in ``order``.

    Give an ``order`` that ends in a unique column; ties are otherwise numbered in no
    defined order. NULL keys form one group. An empty table stays empty. The blocks are
    written to the checkpoint folder once, so a lost executor cannot renumber them.
    """
    by = [F.col(k) for k in keys]
    spread = df.repartitionByRange(*by, *order) if by else df.repartitionByRange(*order)
    blocks = cut_lineage(spread.withColumn("__block", F.spark_partition_id()))
    counts = blocks.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order))
    local = blocks.withColumn("__local", inside)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__block") == F.col("b.__block")]
    joined = local.alias("a").join(shift.alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("__local") + F.col("__shift")).alias(out))


def blocked_running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    The same block scheme as ``blocked_row_number``; NULL values count as 0.
    """
    by = [F.col(k) for k in keys]
    spread = df.repartitionByRange(*by, *order)
    blocks = cut_lineage(spread.withColumn("__block", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0)).cast("long")
    sums = blocks.groupBy(*keys, "__block").agg(F.sum(v).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("__local", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__block") == F.col("b.__block")]
    joined = local.alias("a").join(shift.alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("__local") + F.col("__shift")).alias(out))


def blocked_running_max(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the largest ``value`` over the rows before this one in its group, NULL if none.

    The same block scheme; any type that can be compared, NULL values are passed over. Over
    values made of (order, payload) it carries the last known payload forward.
    """
    by = [F.col(k) for k in keys]
    spread = df.withColumn("__v", value).repartitionByRange(*by, *order)
    blocks = cut_lineage(spread.withColumn("__block", F.spark_partition_id()))
    tops = blocks.groupBy(*keys, "__block").agg(F.max("__v").alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "__block", F.max("__m").over(earlier).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("__local", F.max("__v").over(inside))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__block") == F.col("b.__block")]
    joined = local.alias("a").join(carried.alias("b"), same)
    # within a block rows follow all earlier blocks, so the larger of both counts
    top = F.when(F.col("__local").isNull(), F.col("__carried")).when(F.col("__carried").isNull(), F.col("__local")).otherwise(F.greatest("__local", "__carried"))
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], top.alias(out))
