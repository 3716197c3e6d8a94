"""Filling containers of fixed capacity with texts of varying length (problem 6).

Bounded-space online best-fit: a fixed number of bins is open; their free spaces are the
set bits of one integer, so the tightest bin that still fits is the lowest set bit at or
above the item's size, and the fullest bin, which closes when too many are open, is the
lowest set bit of all. Texts over the capacity are cut into full containers and a rest.

Texts are spread over shards by a hash of their id, each shard packed in one task; a shard
is bounded in tokens, so the number of shards follows the corpus. So many bins are open that
they hold at most an eighth of a shard. What is left open at the end of a shard goes on to
the next level, where eight shards' rests make one shard, packed in the same way, up to the
level with a single shard, whose open bins close as they are.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most open bins, tokens of a shard, shards of a level that make one of the next, most tasks of a level.
OPEN_BINS, SHARD_TOKENS, FAN_IN, MAX_TASKS = 256, 1_000_000, 8, 20_000
#: Fewest open bins, whatever the capacity.
LEAST_BINS = 8


class BestFit:
    """Online best-fit over at most ``open_bins`` bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set if a bin with free space f is open
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, f: int) -> int:
        stack = self.by_free[f]
        b = stack.pop()
        if not stack:
            del self.by_free[f]
            self.free &= ~(1 << f)
        self.n_open -= 1
        return b

    def add(self, size: int) -> int:
        """Number of the bin that takes an item of 1 to ``capacity``."""
        fits = self.free >> size
        if fits:
            f = size + ((fits & -fits).bit_length() - 1)
            b = self._take(f)
        else:
            f, b = self.capacity, self.n_bins
            self.n_bins += 1
        if f > size:
            if self.n_open == self.limit:  # the fullest closes first
                self._take((self.free & -self.free).bit_length() - 1)
            self.by_free.setdefault(f - size, []).append(b)
            self.free |= 1 << (f - size)
            self.n_open += 1
        return b

    def still_open(self) -> set[int]:
        return {b for stack in self.by_free.values() for b in stack}


def _pieces(ids: list, sizes: list[int], capacity: int):
    """(id, piece number, first token, size) with full containers cut off oversize items."""
    for i, n in zip(ids, sizes, strict=True):
        full = n // capacity if n > capacity else 0
        for k in range(full):
            yield i, k, k * capacity, capacity
        if n > full * capacity:
            yield i, full, full * capacity, n - full * capacity


def pack(sizes: DataFrame, id_column: str, containers: list[tuple[str, int]], open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``container_name, bin_id, <id>, piece_no, token_start, n_tokens``, for each capacity.

    ``sizes``: ids and ``n_tokens``. Texts of no tokens are in no container. A text that
    fits is never cut. Ids that occur twice are packed twice. Capacities of 0 or less and
    NULL capacities are an error.
    """
    from corvidex.session import cut_lineage

    if not containers:
        raise ValueError("no container is given")
    for name, cap in containers:
        if cap is None or cap < 1:
            raise ValueError(f"container {name!r} has no capacity")
    kind = sizes.schema[id_column].dataType.simpleString()
    items = cut_lineage(sizes.select(F.col(id_column).alias("id"), "n_tokens").where("n_tokens > 0"))
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_tokens))
    schema = f"container_name string, level int, shard int, bin long, open boolean, id {kind}, piece_no int, token_start long, n_tokens long"
    names = ["container_name", "level", "shard", "bin", "open", "id", "piece_no", "token_start", "n_tokens"]
    bins = {name: max(min(LEAST_BINS, open_bins), min(open_bins, shard_tokens // (FAN_IN * cap))) for name, cap in containers}

    def first(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        ids, sizes, shard, out = f["id"].tolist(), f["n_tokens"].tolist(), int(f["shard"].iloc[0]), []
        for name, cap in containers:
            fit = BestFit(cap, bins[name])
            rows = [(name, 0, shard, fit.add(n), i, k, at, n) for i, k, at, n in _pieces(ids, sizes, cap)]
            left = fit.still_open()
            out += [(*r[:4], r[3] in left, *r[4:]) for r in rows]
        return pd.DataFrame(out, columns=names)

    def tasks(n: int) -> int:
        return max(1, min(n, MAX_TASKS))

    spread = items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    placed = spread.repartition(tasks(shards), "shard").groupBy("shard").applyInPandas(first, schema)
    done, level = None, 0
    while shards > 1:
        placed = cut_lineage(placed)
        closed = placed.where("not open")
        done = closed if done is None else done.unionByName(closed)
        shards, level = math.ceil(shards / FAN_IN), level + 1
        rest = placed.where("open").withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        placed = rest.repartition(tasks(shards * len(containers)), "container_name", "shard").groupBy("container_name", "shard").applyInPandas(_packer(dict(containers), bins, level, names), schema)
    return _named(placed if done is None else done.unionByName(placed), id_column)


def _packer(caps: dict[str, int], bins: dict[str, int], level: int, names: list[str]):
    """Packs the pieces of one container kind and shard online, in order of id and piece."""

    def again(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["id", "piece_no"], kind="stable")
        name = f["container_name"].iloc[0]
        fit = BestFit(caps[name], bins[name])
        f["bin"] = [fit.add(n) for n in f["n_tokens"].tolist()]
        left = fit.still_open()
        f["open"], f["level"] = [b in left for b in f["bin"]], level
        return f[names]

    return again


def _named(rows: DataFrame, id_column: str) -> DataFrame:
    bin_id = F.concat_ws("-", F.concat(F.lit("l"), F.col("level")), F.concat(F.lit("s"), F.col("shard")), "bin")
    return rows.select("container_name", bin_id.alias("bin_id"), F.col("id").alias(id_column), "piece_no", "token_start", "n_tokens")
