"""Mixing sources to target weights (problem 7).

The token stream of each source is cut into blocks of a fixed length. The slots of a mix
are numbered through, output shard by output shard; a keyed pseudorandom permutation of all
slots says which source fills a slot and with which of its own slots. So the counts of a
shard are a multinomial draw conditioned on the totals of the mix: totals come out exactly,
every shard is drawn by itself from (seed, shard) on the executors, and it is one method at
all sizes. A source's slot ``k`` is block ``k mod n`` of pass ``k div n`` under a keyed
permutation of that pass, so a block (and with it a text) is used once per pass and at most
``max_repeats`` times. Slots meet their blocks in a join on (source, block).

The size of a mix is the largest at which every source that has any text reaches its share
within its repeats; the share of sources without text is spread over the others in
proportion. Shares are met up to the rounding of one block per source.

With ``all_reach=False`` only the large sources (those with at least the mean tokens of the
mix's sources) decide on the size; a smaller one stops at its repeats and falls short, and
the others keep their proportions to each other. The queries run so, as a tiny source would
otherwise leave out nearly all text of the others.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.operators.ordering import blocked_running_sum
from corvidex.session import cut_lineage

#: Tokens of a block, slots of an output shard, shards that one task fills, most tasks.
BLOCK_TOKENS, SHARD_SLOTS, SHARDS_PER_TASK, MAX_TASKS = 256, 4096, 16, 20_000


def permute_index(x: np.ndarray, n: int, seed: str) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to ``x`` (Feistel network, cycle-walking)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(seed.encode(), digest_size=32).digest(), dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (h >> np.uint64(29))) & mask
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while len(bad := np.flatnonzero(out >= n)):
        out[bad] = once(out[bad])
    return out.astype(np.int64)


def source_spans(sizes: DataFrame, id_column: str, source: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Which tokens of which text lie in which block of their source.

    ``source, block_no, <id>, token_start, n_tokens`` (positions inside the text). The
    last block of a source may be short. Rows without source or tokens are left out.
    """
    items = sizes.where(F.col(source).isNotNull() & (F.col("n_tokens") > 0)).select(F.col(source).alias("source"), F.col(id_column).alias("id"), "n_tokens")
    placed = blocked_running_sum(items, ["source"], [F.xxhash64("id"), F.col("id")], "n_tokens", "at")
    b = F.lit(block_tokens)
    first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("n_tokens") - 1) / b)
    cut = placed.withColumn("block_no", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("at"), F.col("block_no") * b)
    end = F.least(F.col("at") + F.col("n_tokens"), (F.col("block_no") + 1) * b)
    return cut.select("source", "block_no", F.col("id").alias(id_column), (start - F.col("at")).alias("token_start"), (end - start).alias("n_tokens"))


def plan_mix(targets: list[tuple[str, float, int]], tokens: dict[str, int], block_tokens: int = BLOCK_TOKENS, all_reach: bool = True) -> dict[str, dict]:
    """Slots per source of one mix: ``{source: {share, blocks, slots}}``; see the module text.

    A source that is listed twice has its shares added and the smaller cap; negative or
    NULL shares count as 0, caps below 1 as 0.
    """
    share: dict[str, float] = {}
    cap: dict[str, int] = {}
    for s, p, r in targets:
        share[s] = share.get(s, 0.0) + max(0.0, p or 0.0)
        cap[s] = min(cap.get(s, 1 << 62), max(0, r or 0))
    usable = {s for s in share if share[s] > 0 and cap[s] > 0 and tokens.get(s, 0) > 0}
    scale = sum(share[s] for s in usable)
    mean = sum(tokens[s] for s in usable) / max(1, len(usable))
    deciding = usable if all_reach else {s for s in usable if tokens[s] >= mean}
    size = min((cap[s] * tokens[s] / (share[s] / scale) for s in deciding), default=0.0)
    out = {}
    for s in share:
        n = tokens.get(s, 0)
        blocks = math.ceil(n / block_tokens)
        slots = min(cap[s] * blocks, max(1, round(size * share[s] / scale / (n / blocks)))) if s in usable else 0
        out[s] = {"share": share[s], "cap": cap[s], "blocks": blocks, "slots": slots, "tokens": n}
    return out


def draw_shard(slots: dict[str, int], seed: str, shard: int, shard_slots: int = SHARD_SLOTS) -> dict[str, np.ndarray]:
    """What fills one output shard: for each source the numbers of its own slots.

    ``slots`` is the number of slots of each source in the whole mix. Over all shards every
    slot number of every source comes exactly once.
    """
    names = sorted(s for s in slots if slots[s])
    ends = np.cumsum([slots[s] for s in names], dtype=np.int64)
    total = int(ends[-1]) if names else 0
    place = np.arange(shard * shard_slots, min((shard + 1) * shard_slots, total), dtype=np.int64)
    if not len(place):
        return {}
    at = permute_index(place, total, seed)
    of = np.searchsorted(ends, at, side="right")
    return {names[i]: at[of == i] - (ends[i] - slots[names[i]]) for i in np.unique(of)}


def blocks_of(k: np.ndarray, blocks: int, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Pass and block of the slots ``k`` of a source."""
    turn = k // blocks
    block = np.empty(len(k), dtype=np.int64)
    for t in np.unique(turn):
        own = turn == t
        block[own] = permute_index(k[own] % blocks, blocks, f"{seed}|{t}")
    return turn, block


def mix_sources(sizes: DataFrame, targets: DataFrame, id_column: str, source: str, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, all_reach: bool = True) -> tuple[DataFrame, DataFrame]:
    """The mixes and the shares they reach.

    ``targets``: ``mix_name, source, target_share, max_repeats``, a table of settings that
    is read to the driver together with one size per listed source. Returns

    * ``mix_name, shard, slot, source, repeat_no, block_no, <id>, token_start, n_tokens``;
    * ``mix_name, source, target_share, max_repeats, available_tokens, mixed_tokens,
      actual_share, repeats`` (repeats: passes begun).
    """
    spans = cut_lineage(source_spans(sizes, id_column, source, block_tokens))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats")
    size_of = spans.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(size_of, "source", "left").collect()
    tokens = {r.source: r.tokens or 0 for r in rows}
    plans = {}
    for mix in sorted({r.mix_name for r in rows}):
        plans[mix] = plan_mix([(r.source, r.target_share, r.max_repeats) for r in rows if r.mix_name == mix], tokens, block_tokens, all_reach)
    slots = {mix: {s: p["slots"] for s, p in plan.items()} for mix, plan in plans.items()}
    shards = {mix: -(-sum(x.values()) // shard_slots) for mix, x in slots.items()}
    spark = sizes.sparkSession
    schema = "mix_name string, shard long, source string, repeat_no int, block_no long, k long"

    def fill(frames):
        for f in frames:
            for i in f["id"].tolist():
                for mix, n in shards.items():
                    if i < n:
                        break
                    i -= n
                parts = []
                for source, k in draw_shard(slots[mix], f"{seed}|{mix}", i, shard_slots).items():
                    parts.append((source, k, *blocks_of(k, plans[mix][source]["blocks"], f"{seed}|{mix}|{source}")))
                sources, ks, turns, blocks = zip(*parts, strict=True)
                names = np.repeat(np.array(sources, dtype=object), [len(k) for k in ks])
                yield pd.DataFrame({"mix_name": mix, "shard": i, "source": names, "repeat_no": np.concatenate(turns).astype("int32") + 1, "block_no": np.concatenate(blocks), "k": np.concatenate(ks)})

    n_shards = sum(shards.values())
    tasks = min(max(n_shards // SHARDS_PER_TASK, spark.sparkContext.defaultParallelism), n_shards, MAX_TASKS)
    picked = spark.range(0, n_shards, 1, max(1, tasks)).mapInPandas(fill, schema)
    order = F.xxhash64(F.lit(seed), "mix_name", "shard", "source", "k")
    # the picked slots grow with the corpus, which their estimated size does not show
    mixed = picked.hint("merge").join(spans, ["source", "block_no"]).select(
        "mix_name", "shard", order.alias("slot"), "source", "repeat_no", "block_no", id_column, "token_start", "n_tokens"
    )
    mixed = cut_lineage(mixed)
    reached = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("repeat_no").alias("repeats"))
    listed = [(m, s, p["share"], p["cap"], p["tokens"]) for m, plan in plans.items() for s, p in plan.items()]
    told = spark.createDataFrame(listed, "mix_name string, source string, target_share double, max_repeats int, available_tokens long")
    report = told.join(reached, ["mix_name", "source"], "left")
    total = reached.groupBy("mix_name").agg(F.sum("mixed_tokens").alias("total"))
    report = report.join(total, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats", "available_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
    )
    return mixed, report
