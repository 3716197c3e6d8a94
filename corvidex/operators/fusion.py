"""Fusing ranked candidate lists, and what is done with the fused list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvidex.operators.ordering import blocked_running_sum

# fixed values: weights of the signals and the rank constant
WEIGHTS = {"exact": 4.0, "bm25": 3.0, "bm25_relaxed": 2.0, "recency": 2.0, "authority": 2.0, "impact": 1.0, "rerank": 12.0, "late": 3.0}
K = 60
POOL_LIMIT = 50


def stable_id(db: str = "origin_db", archive: str = "source", path: str = "file_path") -> Column:
    """Identity of a document across pools."""
    return F.concat_ws(":", F.col(db), F.col(archive), F.col(path))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; the limit is pushed below the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def ranked_pool(df: DataFrame, signal: str, order: list[Column], limit: int = POOL_LIMIT, id_column: str = "stable_id") -> DataFrame:
    """``signal, stable_id, rank`` of the best ``limit`` rows (1-based)."""
    top = df.orderBy(*order).limit(limit)
    return top.select(F.lit(signal).alias("signal"), F.col(id_column).alias("stable_id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(pools: DataFrame, weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """Reciprocal rank fusion of ``signal, stable_id, rank`` rows.

    ``stable_id, fused_score, signals`` (map of signal to best rank). A signal without a
    weight counts 1; an id that a pool lists twice counts with its better rank.
    """
    w = WEIGHTS if weights is None else weights
    one = pools.groupBy("stable_id", "signal").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    for s, x in w.items():
        weight = F.when(F.col("signal") == s, x).otherwise(weight)
    return one.groupBy("stable_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "rank")))).alias("signals"),
    )


def fused_order(far: int = 2**31 - 1) -> list[Column]:
    """Order of fused rows: score, then the ranks of exact, authority and recency, then id."""
    r = lambda s: F.coalesce(F.col("signals")[s], F.lit(far))
    return [F.col("fused_score").desc(), r("exact"), r("authority"), r("recency"), F.col("stable_id")]


def add_signal(fused: DataFrame, ranked: DataFrame, weight: float, k: int = K) -> DataFrame:
    """Adds one more ranked list (``stable_id, rank``) to fused scores; unknown ids are left out."""
    r = ranked.groupBy("stable_id").agg(F.min("rank").alias("__r"))
    gain = F.coalesce(weight / (k + F.col("__r")), F.lit(0.0))
    return fused.join(r, "stable_id", "left").withColumn("fused_score", F.col("fused_score") + gain).drop("__r")


def add_score_signal(fused: DataFrame, scored: DataFrame, weight: float, k: int = K) -> DataFrame:
    """Adds ``weight / (k+1) * logistic(score)`` of a model's ``stable_id, score``."""
    s = scored.groupBy("stable_id").agg(F.max("score").alias("__s"))
    gain = F.coalesce(weight / (k + 1) / (1 + F.exp(-F.col("__s"))), F.lit(0.0))
    return fused.join(s, "stable_id", "left").withColumn("fused_score", F.col("fused_score") + gain).drop("__s")


def federated_rrf(hits: DataFrame, limit: int = POOL_LIMIT, k: int = K) -> DataFrame:
    """Unweighted fusion of the best ``limit`` hits of each database, one job for all of them."""
    top = top_per_group(hits, ["origin_db"], [F.col("score"), F.col("doc_id")], limit, "sub_rank")
    return top.select("origin_db", "doc_id", "sub_rank", (1.0 / (k + F.col("sub_rank"))).alias("rrf_score"))


def merge_pools(pools: DataFrame, order: str = "pool_order", position: str = "position", id_column: str = "stable_id", limit: int | None = None) -> DataFrame:
    """Concatenation of ordered pools in which the first occurrence of an id wins."""
    first = Window.partitionBy(id_column).orderBy(order, position)
    out = pools.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return out.orderBy(order, position).limit(limit) if limit is not None else out


def merge_fields(rows: DataFrame, id_column: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per id and field the first non-null value in ``order``."""
    o = F.struct(*order)
    return rows.groupBy(id_column).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), o)).alias(f) for f in fields])


def neighbours(anchors: DataFrame, rows: DataFrame, key: str, seq: str, radius: int, mode: str = "adjacent") -> DataFrame:
    """Rows within ``radius`` positions of an anchor of the same group.

    The band is turned into an equality join: each anchor lists the positions it reaches.
    ``anchors`` has ``key``, ``seq`` and ``anchor_pos``. Each row comes once, with its
    earliest anchor; ``mode`` is adjacent (before and after), after, or off.
    """
    if mode == "off":
        return rows.limit(0).withColumns({"anchor_pos": F.lit(0), "distance": F.lit(0)})
    offsets = [i for i in range(-radius if mode == "adjacent" else 1, radius + 1) if i]
    reach = anchors.select(key, "anchor_pos", F.col(seq).alias("__a"), F.explode(F.array(*map(F.lit, offsets))).alias("distance"))
    reach = reach.select(key, "anchor_pos", "distance", (F.col("__a") + F.col("distance")).alias(seq))
    known = anchors.select(key, seq)
    first = Window.partitionBy(key, seq).orderBy("anchor_pos", F.abs("distance"), "distance")
    one = reach.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows.join(one, [key, seq]).join(known, [key, seq], "left_anti")


def pack_budget(items: DataFrame, group: list[str], order: list[Column], size: str, budget: int, skip: bool = True) -> DataFrame:
    """Greedy packing in order. ``skip``: an item that does not fit is passed over and the
    next is tried; otherwise packing stops there. Adds ``used_before``.

    With ``skip`` the fold is sequential by nature: a group is read in order by one task,
    row by row, and never collected. Rows with a NULL group or size are left out. Without
    it, a running sum decides.
    """
    if not skip:
        out = blocked_running_sum(items, group, order, size, "used_before")
        return out.where(F.col("used_before") + F.col(size) <= budget)

    def fold(batches):
        key, used = None, 0
        for b in batches:
            keep, at = [], []
            keys = zip(*[b.column(g).to_pylist() for g in group], strict=True)
            for i, (k, n) in enumerate(zip(keys, b.column(size).to_pylist(), strict=True)):
                if k != key:
                    key, used = k, 0
                if used + n <= budget:
                    keep.append(i)
                    at.append(used)
                    used += n
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "used_before"])

    schema = StructType([*items.schema.fields, StructField("used_before", LongType())])
    known = items.dropna(subset=[*group, size])
    return known.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(fold, schema)


def passages(df: DataFrame, key: list[str], text: str, window: int = 900, stride: int = 675) -> DataFrame:
    """Overlapping windows of a text; the last one ends with the text.

    ``<key>, passage_no, char_start, char_end, passage``; empty and NULL texts have none.
    """
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(stride)).cast("int"))
    rows = df.where(F.coalesce(n, F.lit(0)) > 0).select(*key, text, F.posexplode(F.sequence(F.lit(0), last)).alias("passage_no", "__i"))
    start = F.col("__i") * stride
    return rows.select(
        *key, "passage_no", start.alias("char_start"), F.least(start + window, n).alias("char_end"), F.substring(F.col(text), start + 1, F.lit(window)).alias("passage")
    )


def passage_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def overlap_score(tokens: Column, words: list[str]) -> Column:
    """Share of the distinct query words found among tokens, to four places."""
    if not words:
        return F.lit(0.0)
    w = sorted(set(words))
    return F.round(F.size(F.array_intersect(tokens, F.array(*map(F.lit, w)))) / F.lit(float(len(w))), 4)


def rerank(fused: DataFrame, scores: DataFrame, mode: str = "rrf", weight: float = WEIGHTS["rerank"]) -> DataFrame:
    """Applies model scores (``stable_id, score``) to a fused list.

    ``rrf``: scored rows, ranked by score, become one more signal; ``score``: the logistic
    of the score is added; ``cut``: scored rows come first, in score order.
    """
    best = scores.groupBy("stable_id").agg(F.max("score").alias("score"))
    if mode == "score":
        return add_score_signal(fused, best, weight)
    ranked = best.join(fused.select("stable_id"), "stable_id", "left_semi").withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "stable_id")))
    if mode == "rrf":
        return add_signal(fused, ranked, weight)
    if mode == "cut":
        return fused.join(ranked.select("stable_id", F.col("rank").alias("cut_rank")), "stable_id", "left")
    raise ValueError(f"mode must be rrf, score or cut, not {mode!r}")
