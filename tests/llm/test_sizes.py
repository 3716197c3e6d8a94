import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvidex.llm.mixing import draw_shard, mix_sources, permute_index, plan_mix
from corvidex.llm.packing import BestFit, pack
from corvidex.llm.tokens import _encoding, token_counts


def test_best_fit_against_plain_search():
    rng = random.Random(3)
    for limit in (1, 3, 1000):
        fit, bins, order = BestFit(100, limit), [], []
        for _ in range(500):
            n = rng.randrange(1, 101)
            b = fit.add(n)
            fits = [i for i in order if bins[i] >= n]
            if fits:
                assert bins[b] == min(bins[i] for i in fits) and b in order
            else:
                assert b == len(bins)
                bins.append(100)
            if b in order:
                order.remove(b)
            bins[b] -= n
            if bins[b]:
                if len(order) == limit:
                    fullest = min(bins[i] for i in order)
                    closed = [i for i in order if bins[i] == fullest and i not in fit.still_open()]
                    assert len(closed) == 1
                    order.remove(closed[0])
                order.append(b)
            assert set(order) == fit.still_open()


@pytest.mark.parametrize("shard_tokens", [10**9, 3000])
def test_pack(spark, shard_tokens):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 40, 99, 100, 101, 350, 7])) for i in range(600)] + [(5, 40)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", [("a", 100), ("b", 256)], 16, shard_tokens).collect()
    for name, cap in (("a", 100), ("b", 256)):
        own = [r for r in out if r.container_name == name]
        fill = Counter()
        for r in own:
            fill[r.bin_id] += r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(n for _, n in rows)
        assert sum(fill.values()) / (len(fill) * cap) > 0.9
        pieces = Counter(r.doc_id for r in own)
        size = Counter()
        for i, n in rows:
            size[i] += -(-n // cap)
        assert pieces == +size  # nothing that fits is cut, and the rest only into full containers
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", [("a", 0)])
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", [("a", 9)]).count() == 0


def test_levels_of_packing(spark):
    """Many shards and levels: nothing is lost or cut, every level is bounded, little room is left."""
    rng = random.Random(6)
    rows = [(i, min(4000, int(rng.lognormvariate(4, 1.2)) + 1)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = pack(df, "doc_id", [("small", 2048), ("large", 8192)], 256, 20_000).toPandas()
    total = sum(n for _, n in rows)
    for name, cap in (("small", 2048), ("large", 8192)):
        own = out[out.container_name == name]
        fill = own.groupby("bin_id").n_tokens.sum()
        assert fill.max() <= cap and fill.sum() == total
        assert total / (len(fill) * cap) > 0.94
        assert len({b.split("-")[0] for b in fill.index}) >= 3
        pieces = own.groupby("doc_id").size().to_dict()
        assert pieces == {i: -(-n // cap) for i, n in rows}


def test_token_counts(spark):
    texts = ["", None, "Żółta flaga", "x" * 100_000, "plain words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    enc = _encoding("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[2])) == texts[2]


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4096):
        assert sorted(permute_index(np.arange(n), n, "s")) == list(range(n))
    assert list(permute_index(np.arange(50), 50, "a")) != list(permute_index(np.arange(50), 50, "b"))


def test_plan_and_draw():
    plan = plan_mix([("big", 0.5, 1), ("small", 0.3, 3), ("none", 0.2, 9)], {"big": 1_000_000, "small": 25_600}, 256)
    assert plan["none"]["slots"] == 0 and plan["small"]["slots"] == 300 and plan["big"]["slots"] == 500
    slots = {s: p["slots"] for s, p in plan.items()}
    drawn = [draw_shard(slots, "1", i, 64) for i in range(-(-800 // 64))]
    assert [sum(map(len, d.values())) for d in drawn] == [64] * 12 + [32]
    for s in ("big", "small"):  # every slot of every source once, and each shard near the shares
        assert sorted(k for d in drawn for k in d.get(s, [])) == list(range(slots[s]))
        assert all(abs(len(d[s]) / 64 - slots[s] / 800) < 0.25 for d in drawn[:12])
    again = draw_shard(slots, "1", 5, 64)
    assert all((again[s] == drawn[5][s]).all() for s in again) and len(draw_shard(slots, "1", 13, 64)) == 0
    assert plan_mix([], {}, 256) == {} and draw_shard({}, "1", 0) == {}
    huge = draw_shard({"a": 3 * 10**12, "b": 10**12}, "1", 10**8)  # no size at which the draw changes
    assert abs(len(huge["a"]) / 4096 - 0.75) < 0.05 and huge["b"].max() < 10**12 and huge["a"].min() >= 0


def test_draws_are_spread_like_a_multinomial_without_replacement():
    slots = {"a": 6000, "b": 3000, "c": 1000}
    n = np.array([[len(draw_shard(slots, "7", i, 100).get(s, [])) for s in "abc"] for i in range(100)])
    assert (n.sum(0) == [6000, 3000, 1000]).all()
    want = np.array([100 * p * (1 - p) * 9900 / 9999 for p in (0.6, 0.3, 0.1)])
    assert (np.abs(n.var(0) / want - 1) < 0.6).all()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 5 + ["rare"] + [None]), rng.randrange(0, 900)) for i in range(900)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "hot", 0.4, 2), ("m", "rare", 0.4, 3), ("m", "gone", 0.2, 3), ("n", "gone", 1.0, 3)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = mix_sources(sizes, targets, "doc_id", "source", block_tokens=64, shard_slots=128)
    used = defaultdict(Counter)
    for r in mixed.collect():
        for t in range(r.token_start, r.token_start + r.n_tokens):
            used[r.source, r.doc_id][t] += 1
    cap = {"hot": 2, "rare": 3}
    size = {i: n for i, _, n in rows}
    assert all(max(c.values()) <= cap[s] and max(c) < size[i] for (s, i), c in used.items())
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(rep["m", "hot"].actual_share - 0.5) < 0.01 and abs(rep["m", "rare"].actual_share - 0.5) < 0.01
    assert rep["m", "gone"].actual_share == 0 and rep["n", "gone"].mixed_tokens == 0
    assert rep["m", "rare"].repeats == 3 and len(rep) == 4


def test_tiny_source_does_not_set_the_size(spark):
    targets, tokens = [("big", 0.5, 1), ("wide", 0.3, 2), ("tiny", 0.2, 3)], {"big": 512_000, "wide": 512_000, "tiny": 2560}
    plan = plan_mix(targets, tokens, 256, all_reach=False)
    assert (plan["big"]["slots"], plan["wide"]["slots"], plan["tiny"]["slots"]) == (2000, 1200, 30)
    rows = [(i, "big", 500) for i in range(200)] + [(1000 + i, "wide", 500) for i in range(200)] + [(5000, "tiny", 640)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    wanted = spark.createDataFrame([("m", *t) for t in targets], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = mix_sources(sizes, wanted, "doc_id", "source", block_tokens=64, all_reach=False)
    assert mixed.where("source = 'big'").select("doc_id").distinct().count() == 200
    rep = {r.source: r for r in report.collect()}
    assert rep["tiny"].mixed_tokens == 3 * 640 and rep["tiny"].repeats == 3 and rep["tiny"].actual_share < 0.02
    assert abs(rep["wide"].mixed_tokens / rep["big"].mixed_tokens - 0.6) < 0.01


def test_registered_mixes_use_the_large_sources(spark, tmp_path):
    from corvidex.llm.q_sizes import p7_shares

    texts = [(i, "big", "plain words here " * 40) for i in range(60)] + [(99, "tiny", "word")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("m", "big", 0.5, 1), ("m", "tiny", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r.source: r for r in p7_shares(spark, str(tmp_path)).collect()}
    assert got["big"].mixed_tokens == got["big"].available_tokens and got["tiny"].mixed_tokens == 2 * got["tiny"].available_tokens
