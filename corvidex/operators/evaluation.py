"""Retrieval metrics, comparisons of systems, bootstrap intervals and fact coverage."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANT_GRADE = 2


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade.cast("double")) - 1) / F.log2((rank + 1).cast("double"))


def query_metrics(ranked: DataFrame, labels: DataFrame, recall_at: tuple[int, ...] = (10, 50, 100), cut: int = 10, success_at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Metrics per query: recall, nDCG, reciprocal rank, success, zero result.

    ``ranked``: ``qid, doc, rank`` (1-based); ``labels``: ``qid, doc, grade`` (a document
    once per query). A document listed twice counts once for recall and nDCG, after the
    cut, and its place closes up. Metrics are NULL where they are not defined (no relevant
    label, no positive grade). Queries come from the labels and the ranked lists together.
    """
    hits = ranked.join(labels, ["qid", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("qid", "doc").orderBy("rank"))
    hits = hits.withColumn("nth", first)
    once = hits.where("nth = 1").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    relevant = F.col("grade") >= RELEVANT_GRADE
    per = hits.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_ranked"),
        F.min(F.when(relevant & (F.col("rank") <= cut), F.col("rank"))).alias("first_hit"),
        *[F.max((relevant & (F.col("rank") <= k)).cast("int")).alias(f"s{k}") for k in success_at],
    )
    found = once.groupBy("qid").agg(
        *[F.count_if(relevant & (F.col("rank") <= k)).alias(f"r{k}") for k in recall_at],
        F.sum(F.when(F.col("rank") <= cut, _gain(F.col("grade"), F.col("place")))).alias("dcg"),
    )
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "doc"))
    ideal = labels.where("grade > 0").withColumn("place", ideal_rank).where(F.col("place") <= cut)
    ideal = ideal.groupBy("qid").agg(F.sum(_gain(F.col("grade"), F.col("place"))).alias("ideal"))
    wanted = labels.groupBy("qid").agg(F.count_if(relevant).alias("n_relevant"))
    queries = labels.select("qid").union(ranked.select("qid")).distinct()
    j = queries.join(wanted, "qid", "left").join(ideal, "qid", "left").join(per, "qid", "left").join(found, "qid", "left")
    some = F.coalesce(F.col("n_relevant"), F.lit(0)) > 0
    return j.select(
        "qid",
        (F.col("n_ranked").isNull()).cast("double").alias("zero_result"),
        *[F.when(some, F.coalesce(f"r{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}") for k in recall_at],
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias(f"ndcg_{cut}"),
        F.when(some, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias(f"mrr_{cut}"),
        *[F.when(some, F.coalesce(f"s{k}", F.lit(0)).cast("double")).alias(f"success_{k}") for k in success_at],
    )


def mean_metrics(scores: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Means per group and over all, NULLs skipped, with the number of queries."""
    sets = [[F.col(g) for g in group], []] if group else [[]]
    return scores.groupingSets(sets, *group).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in metrics])


class JavaRandom:
    """The linear congruential generator of ``java.util.Random``, for reproducible intervals."""

    # fixed values: multiplier and mask of the generator
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        v = self.state >> (48 - n)
        return v - (1 << n) if n == 32 and v >> 31 else v

    def below(self, n: int) -> int:
        if n & (n - 1) == 0:
            return (n * self.bits(31)) >> 31
        while True:
            b = self.bits(31)
            v = b % n
            if b - v + n - 1 < 1 << 31:
                return v


#: Draws made at once, so that they and what they pick stay in a core's cache.
DRAWS = 1 << 14


class JavaDraws:
    """Numbers below ``n`` as ``java.util.Random.nextInt(n)`` gives them, in blocks.

    The generator is linear, so the state after any number of steps has a closed form: a
    block of states comes from one state by a table of powers. A draw that the generator
    rejects just takes the next one, so rejected draws are filtered out of the stream.
    """

    # fixed values: multiplier, increment and width of the generator
    def __init__(self, seed: int, n: int):
        a, c, self.mask = 0x5DEECE66D, 0xB, (1 << 48) - 1
        self.power, self.add = np.empty(DRAWS, np.uint64), np.empty(DRAWS, np.uint64)
        p, q = 1, 0
        for i in range(DRAWS):
            p, q = p * a & self.mask, (q * a + c) & self.mask
            self.power[i], self.add[i] = p, q
        self.n, self.state, self.room = n, (seed ^ a) & self.mask, np.empty(DRAWS, np.uint64)
        self.rest = np.empty(0, np.uint32)

    def block(self) -> np.ndarray:
        """The numbers that the next ``DRAWS`` states give."""
        room = np.multiply(self.power, np.uint64(self.state), out=self.room)  # wraps at 64 bits, which keeps the low 48
        room += self.add
        self.state = int(room[-1]) & self.mask
        room >>= np.uint64(17)
        bits = room.astype(np.uint32)
        bits &= np.uint32((1 << 31) - 1)
        if self.n & (self.n - 1) == 0:
            return bits >> np.uint32(32 - self.n.bit_length())
        quotient = bits // np.uint32(self.n)
        quotient *= np.uint32(self.n)
        whole = np.uint32((1 << 31) // self.n * self.n)  # from here on the last range of n numbers isn't full
        return (bits - quotient)[bits < whole] if bits.max() >= whole else bits - quotient

    def take(self, count: int) -> np.ndarray:
        """The next ``count`` numbers."""
        parts, have = [self.rest], len(self.rest)
        while have < count:
            parts.append(self.block())
            have += len(parts[-1])
        got = np.concatenate(parts)
        self.rest = got[count:]
        return got[:count]


def java_draws(seed: int, n: int, count: int) -> np.ndarray:
    """``count`` numbers below ``n`` as ``java.util.Random.nextInt(n)`` gives them."""
    return JavaDraws(seed, n).take(count).astype(np.int64)


def _interval(differences: Sequence[float], draw: Callable[[int], np.ndarray], resamples: int, low: int, high: int) -> tuple[float, float, float, int]:
    """Mean and the order statistics ``low`` and ``high`` of the means of all resamples.

    ``draw`` gives the next so many draws. A resample is summed before the next one is drawn
    (short ones several at a time), so memory holds the differences twice and the means, not
    the draws.
    """
    d = np.asarray(differences, dtype=float)
    n, means = len(d), np.empty(resamples)
    step = min(resamples, max(1, DRAWS // n))
    picked = np.empty(step * n)
    for r in range(0, resamples, step):
        size = min(step, resamples - r) * n
        for i in range(0, size, DRAWS):
            part = picked[i : min(i + DRAWS, size)]
            np.take(d, draw(len(part)), out=part, mode="clip")  # no draw is out of range; clip takes no copy
        means[r : r + step] = picked[:size].reshape(-1, n).mean(axis=1)
    means.sort()
    return float(d.mean()), float(means[low]), float(means[high]), n


def bootstrap_java(differences: Sequence[float], resamples: int = 10_000, seed: int = 42) -> tuple[float | None, float | None, float | None, int]:
    """Mean and 95 % interval of paired differences (percentiles by floor and ceiling)."""
    if not len(differences):
        return None, None, None, 0
    return _interval(differences, JavaDraws(seed, len(differences)).take, resamples, math.floor(0.025 * (resamples - 1)), math.ceil(0.975 * (resamples - 1)))


def bootstrap_python(differences: Sequence[float], resamples: int = 10_000, seed: int = 1) -> tuple[float | None, float | None, float | None, int]:
    """The same with the draws of Python's ``random.choices``; the interval is the 2.5 and 97.5 % order statistics."""
    n = len(differences)
    if not n:
        return None, None, None, 0
    _, state, _ = random.Random(seed).getstate()
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    generator, room = np.random.Generator(twister), np.empty(DRAWS)

    def draw(k: int) -> np.ndarray:
        u = generator.random(out=room[:k])
        u *= n
        return u.astype(np.intp)  # none is negative, so this is the floor

    return _interval(differences, draw, resamples, int(0.025 * resamples), int(0.975 * resamples) - 1)


#: Ranges of the groups, by rows: a group of more than a range has its own task. The number is stated, as else
#: adaptive execution puts all groups, few bytes each, in one task.
GROUP_TASKS = 64


def bootstrap(pairs: DataFrame, group: list[str], method: Callable = bootstrap_java, resamples: int = 10_000, seed: int = 42, order: str = "qid") -> DataFrame:
    """Interval per group of ``difference`` rows, in the order of ``order``.

    A group is one comparison of two systems over a set of labelled queries. All its draws
    come from one generator in their order, so it is one task's work: time goes with pairs
    times resamples, memory with pairs. NULL differences are skipped.
    """
    kinds = ", ".join(f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        d = f.dropna(subset=["difference"]).sort_values(order)["difference"].to_numpy(float)
        mean, low, high, n = method(d, resamples, seed)
        return pd.DataFrame([[*(f[g].iloc[0] for g in group), mean, low, high, n]], columns=[*group, "mean_diff", "ci_low", "ci_high", "pairs"])

    rows = pairs.select(*dict.fromkeys([*group, order, "difference"])).repartitionByRange(GROUP_TASKS, *group)
    return rows.groupBy(*group).applyInPandas(run, f"{kinds}, mean_diff double, ci_low double, ci_high double, pairs long")


def paired_report(values: DataFrame, base: str, other: str, group: list[str]) -> DataFrame:
    """Means, wins, losses, ties, best and worst difference of two systems per group.

    ``values``: ``qid, system, value`` and the group columns.
    """
    one = values.where(F.col("system").isin(base, other)).groupBy(*group, "qid").agg(
        F.max(F.when(F.col("system") == base, F.col("value"))).alias("a"), F.max(F.when(F.col("system") == other, F.col("value"))).alias("b")
    )
    d = one.where("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    return d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("a").alias("mean_base"), F.avg("b").alias("mean_other"), F.avg("d").alias("mean_diff"),
        F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"),
        F.min("d").alias("worst"), F.max("d").alias("best"),
    )


def fact_recall(present: DataFrame, facts: DataFrame, cuts: tuple[int, ...] = (10, 30, 50, 100)) -> DataFrame:
    """Weighted share of facts that appear among the first k texts, per task.

    ``present``: ``task, fact, rank``; ``facts``: ``task, fact, weight``.
    """
    first = present.groupBy("task", "fact").agg(F.min("rank").alias("rank"))
    j = facts.join(first, ["task", "fact"], "left")
    return j.groupBy("task").agg(*[(F.sum(F.when(F.col("rank") <= k, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(f"fact_recall_{k}") for k in cuts])


def fact_dcg(present: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """Discounted gain of new facts: a fact counts where it first appears."""
    first = present.join(facts, ["task", "fact"]).groupBy("task", "fact").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    return first.where(F.col("rank") <= k).groupBy("task").agg(F.sum(F.col("weight") / F.log2(F.col("rank") + 1.0)).alias("dcg"))


def lazy_greedy(sets: list[dict[str, float]], boost: list[float] | None = None) -> Iterator[tuple[int, float]]:
    """Indexes of ``sets`` in greedy order of the weight they add, with that weight.

    A heap holds what each set was last known to add, which can only have shrunk since, so
    only the set on top is weighed again. Ends when nothing is added; ties go to the earlier.
    """
    boosts = boost or [1.0] * len(sets)
    heap = [(-sum(s.values()) * b, i) for i, (s, b) in enumerate(zip(sets, boosts, strict=True))]
    heapq.heapify(heap)
    covered: set[str] = set()
    while heap:
        known, i = heap[0]
        now = sum(w for x, w in sets[i].items() if x not in covered) * boosts[i]
        if now != -known:
            heapq.heapreplace(heap, (-now, i))
            continue
        heapq.heappop(heap)
        if now <= 0:
            return
        covered.update(sets[i])
        yield i, now


def ideal_dcg(text_facts: list[set[str]], weights: dict[str, float], k: int = 10) -> float:
    """Discounted gain of the best greedy order of the texts."""
    order = lazy_greedy([{f: weights.get(f, 0.0) for f in sorted(t)} for t in text_facts])
    return sum(gain / math.log2(place) for place, (_, gain) in zip(range(2, k + 2), order, strict=False))


def ndcg_coverage(present: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """``task, dcg, ideal, ndcg``: gain of new facts over that of the best greedy order.

    ``present``: ``task, fact, rank``; a task's list is the result of one search, so its
    facts by text fit one row; ``facts``: ``task, fact, weight``.
    """
    texts = present.join(facts, ["task", "fact"]).groupBy("task", "rank").agg(F.collect_set("fact").alias("facts"))
    own = texts.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("rank", "facts"))).alias("texts"))
    weights = facts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("fact", "weight"))).alias("weights"))

    @F.pandas_udf("double")
    def best(texts: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([ideal_dcg([set(t["facts"]) for t in x], dict(w), k) for x, w in zip(texts, weights, strict=True)], dtype="float64")

    ideal = own.join(weights, "task").select("task", best("texts", "weights").alias("ideal"))
    return fact_dcg(present, facts, k).join(ideal, "task").select("task", "dcg", "ideal", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def precision_proxy(present: DataFrame, ranked: DataFrame, cuts: tuple[int, ...] = (10,)) -> DataFrame:
    """Share of the first k texts of each task that hold any fact. ``ranked``: ``task, rank``."""
    useful = present.select("task", "rank").distinct().withColumn("u", F.lit(1))
    j = ranked.select("task", "rank").join(useful, ["task", "rank"], "left")
    return j.groupBy("task").agg(*[(F.count_if((F.col("rank") <= k) & F.col("u").isNotNull()) / F.least(F.lit(k), F.max("rank"))).alias(f"precision_{k}") for k in cuts])


def needles(ledger: DataFrame, per_task: int = 3) -> DataFrame:
    """Questions made of the plain words of a fact: ``task, fact, query``, the first ``per_task`` of each task.

    ``ledger``: ``task, place, fact, weight, words``. Facts of weight below 2 or with fewer
    than two plain words make no question.
    """
    plain = F.filter("words", lambda w: w.rlike(r"^[\p{L}\p{N}_-]+$"))
    rows = ledger.withColumn("plain", plain).where((F.col("weight") >= 2) & (F.size("plain") >= 2))
    n = F.row_number().over(Window.partitionBy("task").orderBy("place", "fact"))
    return rows.withColumn("n", n).where(F.col("n") <= per_task).select("task", "fact", F.array_join("plain", " ").alias("query"))


def pool(lists: DataFrame, id_column: str, depth: int | None = None) -> DataFrame:
    """What is to be labelled: ``<id>, systems, best``, each document of any list once.

    ``lists``: ``system, <id>, pos``; ``systems`` are those that found it, ``best`` its best place.
    """
    rows = lists.where(F.col("pos") <= depth) if depth is not None else lists
    return rows.groupBy(id_column).agg(F.sort_array(F.collect_set("system")).alias("systems"), F.min("pos").alias("best"))


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """``n`` rows with the smallest salted hash: the same rows whatever their order."""
    return df.orderBy(F.xxhash64(F.lit(salt), key), key).limit(n)


def fingerprint(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Order-independent fingerprint per group: counts and two sums of row hashes.

    Unlike a running hash over sorted rows it needs no order and combines map-side.
    """
    h = F.xxhash64(key, value)
    h2 = F.xxhash64(F.lit("corvidex"), key, value)
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.count(F.lit(1)), total(h), total(h2)), 256).alias("fingerprint"))


def greedy_coverage(candidates: DataFrame, group: list[str], df_table: DataFrame, n_docs: int, count: int, recency: float = 0.5) -> DataFrame:
    """Greedy choice of texts that add most idf of informative tokens not covered yet.

    ``candidates``: group columns, ``id``, ``sequence``, ``tokens``; a group is the pool of
    one query or ticket (bounded by the pool limit). ``df_table``: ``token, df``; only the
    candidates' tokens are joined. Returns ``id`` and ``pick`` (1, 2, ...). The newest text
    weighs ``1 + recency``; the loop ends when nothing is gained.
    """
    kind = candidates.schema["id"].dataType.simpleString()
    kinds = "".join(f"{g} {candidates.schema[g].dataType.simpleString()}, " for g in group)
    weight = F.ln(F.lit(float(n_docs)) / F.greatest(F.lit(1.0), F.coalesce(F.col("df"), F.lit(1)).cast("double")))
    rows = candidates.select(*group, "id", "sequence", F.explode(F.array_distinct("tokens")).alias("token")).where(informative(F.col("token")))
    rows = rows.join(df_table, "token", "left").select(*group, "id", "sequence", "token", weight.alias("idf"))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        texts = [(i, g["sequence"].iloc[0], dict(zip(g["token"], g["idf"], strict=True))) for i, g in f.sort_values(["id", "token"]).groupby("id")]
        ids, sequences, tokens = (list(x) for x in zip(*texts, strict=True))
        age = np.array(sequences, dtype=float) - min(sequences)
        order = lazy_greedy(tokens, list(1 + recency * age / max(1.0, age.max())))
        picked = [ids[i] for i, _ in islice(order, count)]
        own = {g: [f[g].iloc[0]] * len(picked) for g in group}
        return pd.DataFrame({**own, "id": picked, "pick": np.arange(1, len(picked) + 1)})

    return rows.groupBy(*group).applyInPandas(choose, f"{kinds}id {kind}, pick int")


def informative(token: Column) -> Column:
    """Long tokens, and those with a digit or one of ``_ # . / -``."""
    return (F.char_length(token) >= 7) | token.rlike(r"[0-9_#./-]")


def covered_share(texts: DataFrame, words: list[str], text: str) -> DataFrame:
    """Share of query words that occur in at least one text (0 without words or texts)."""
    if not words:
        return texts.agg(F.lit(0.0).alias("covered"))
    low = F.lower(F.coalesce(text, F.lit("")))
    flags = [F.coalesce(F.max(F.contains(low, F.lit(w)).cast("int")), F.lit(0)) for w in words]
    return texts.agg((sum(flags, F.lit(0)) / F.lit(float(len(words)))).alias("covered"))
