import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import aggregates as A
from corvidex.operators import evaluation as E
from corvidex.operators import fts, fusion
from corvidex.operators import joins as J
from corvidex.operators import journal as JR
from corvidex.operators import vectors as V
from corvidex.operators.retrieval import Options
from corvidex.plans import planner as P


# --- planner ---
def test_planner():
    p = P.plan_query("What did we decide about the retry budget?")
    assert p.terms == ["decide", "retry", "budget"] and p.relaxed == "decide OR deci* OR retry OR retr* OR budget OR budg*"
    assert P.plan_query("the of").terms == ["the", "of"] and P.plan_query(None).relaxed is None
    assert P.plan_query('a "phrase"').explicit and P.is_explicit("file_path:x") and not P.is_explicit("plain words")
    assert P.l_variants("bylo") == ["było"] and len(P.l_variants("mlody lis".split()[0])) == 1 and P.l_variants("allll") == []
    assert P.language_guess(["była"]) == "pl" and P.language_guess("where is it".split()) == "en"
    assert P.normalize_query("core/A.java") == '"core/A.java"' and P.normalize_query("a-b AND c") == '"a-b" AND c'
    assert P.split_ticket("fix ABC-12 now") == ("ABC-12", "fix now") and P.split_ticket("ABC-1 OR DEF-2")[0] is None
    assert P.is_generic("current status".split()) and not P.is_generic(["cursor"])
    for bad in ("AND", "a AND", "(a", "a)", "NEAR(a b", '"  "'):
        with pytest.raises(P.QuerySyntaxError):
            P.parse_match(bad)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_planner_never_breaks(raw):
    plan = P.plan_query(raw)
    assert len(plan.terms) + len(plan.removed) <= len(raw.split()) or plan.explicit
    P.normalize_query(raw)


# --- full text against a plain search ---
def brute(docs, query):
    tree = P.parse_match(query)

    def count(p, arrs):
        total = 0
        for col, arr in arrs.items():
            if p.column in (None, col):
                for i in range(len(arr) - len(p.words) + 1):
                    words = arr[i : i + len(p.words)]
                    same = words[:-1] == list(p.words[:-1]) and (words[-1].startswith(p.words[-1]) if p.prefix else words[-1] == p.words[-1])
                    total += same
        return total

    def holds(n, arrs):
        if n.op == "phrase":
            return count(n.phrase, arrs) > 0
        if n.op == "not":
            return holds(n.args[0], arrs) and not holds(n.args[1], arrs)
        return (all if n.op == "and" else any)(holds(a, arrs) for a in n.args)

    out = {}
    for db in {d[1] for d in docs}:
        own = [(d[0], {"file_path": d[2].split(), "file_name": [], "content": (d[3] or "").split()}) for d in docs if d[1] == db]
        size = {i: sum(map(len, a.values())) for i, a in own}
        avg = sum(size.values()) / len(own)
        for i, arrs in own:
            if holds(tree, arrs):
                score = 0.0
                for p in tree.phrases():
                    n, f = sum(count(p, a) > 0 for _, a in own), count(p, arrs)
                    idf = math.log((len(own) - n + 0.5) / (n + 0.5))
                    score -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / avg))
                out[i] = round(score, 6)
    return out


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "alphabet", "beta", "gamma", "delta"]
    docs = [(i, rng.choice(["a.db", "b.db"]), rng.choice(words), None if i == 7 else " ".join(rng.choices(words, k=rng.randrange(0, 9))), "") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, origin_db string, file_path string, content string, file_name string")
    source = fts.index_source(df, "content", extract=False)
    for q in ("alpha", "alpha beta", "alpha OR gamma", "alpha NOT beta", '"alpha beta"', "alph*", "content:beta", "(alpha OR beta) gamma"):
        got = {r.doc_id: round(r.score, 6) for r in fts.search_scan(source, q).collect()}
        want = brute(docs, q)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got), q
    assert fts.search_scan(source.limit(0), "alpha").count() == 0


def test_index_equals_scan(spark, tmp_path):
    """Words, prefixes, phrases with prefixes, columns, NEAR: the index gives what reading the texts gives."""
    rng = random.Random(4)
    words = ["alpha", "alphabet", "al", "beta", "gamma", "delta", "ż", "zażółć", "x"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, rng.choice(["a.db", "b.db", None]), text(2), None if i == 7 else text(rng.randrange(0, 12)), text(1)) for i in range(90)]
    docs += [(200, "a.db", "beta", " ".join(["beta"] * 3000), "beta"), (201, "c.db", None, "", None), (202, "a.db", "alpha", "alpha beta", "again")]
    df = spark.createDataFrame(docs, "doc_id int, origin_db string, file_path string, content string, file_name string").withColumn("tf", F.lit("clash"))
    source = fts.index_source(df, "content", extract=False)
    fts.write_index(source, f"{tmp_path}/index", buckets=8)
    index = fts.open_index(spark, f"{tmp_path}/index")
    queries = ["alpha", "alpha OR gamma", "alpha NOT beta", '"alpha beta"', "alph*", "a*", "z*", "content:beta", "(alpha OR beta) gamma", '"beta al"*', '"beta beta"',
               "NEAR(alpha beta, 2)", "NEAR(content:gamma alph*, 3)", 'NEAR("alpha beta" gamma, 1) OR delta', "file_name:x AND content:ż", "nowhere", "beta NOT nowhere", "NEAR(beta beta, 0)"]
    for q in queries:
        rows = lambda x: sorted((str(r.origin_db), r.doc_id, round(r.score, 6)) for r in x.collect())
        assert rows(index.search(q)) == rows(fts.search_scan(source, q)), q
    plan = index.search("content:beta")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert "PushedFilters" in plan and "EqualTo(term,beta)" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    fts.write_index(source.limit(0), f"{tmp_path}/none")
    assert fts.open_index(spark, f"{tmp_path}/none").search("alpha NOT beta*").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("---\nmode: \"plan\"\na: x: y\n---\nbody ABC-1 SCTASK12 ABC-1",), (None,), ("",), ("ŻÓŁW ø É",)], "t string")
    rows = df.select(T.front_matter_map(F.col("t")).alias("m"), T.tickets(F.col("t")).alias("k"), T.fts_fold(F.col("t")).alias("f"), T.ascii_fold(F.col("t")).alias("a"), T.search_body(F.col("t")).alias("b"), T.tokens(F.col("t")).alias("w")).collect()
    assert rows[0].m == {"mode": "plan", "a": "x: y"} and rows[0].k == ["ABC-1", "SCTASK12"] and rows[0].b == "body ABC-1 SCTASK12 ABC-1"
    assert rows[1].m is None and rows[1].k == [] and rows[1].w == [] and rows[2].b == ""
    assert rows[3].f == "zołw ø e" and rows[3].a == "zolw o e"
    s = spark.createDataFrame([("x" * 300 + " needle " + "y" * 400,), (None,), ("short",)], "t string").select(T.snippet(F.col("t"), ["needle"]).alias("s"), T.preview(F.col("t"), ["needle"], 30).alias("p")).collect()
    assert s[0].s.startswith("...x") and ">>>needle<<<" in s[0].s and s[1].s == "" and s[2].s == "short" and "needle" in s[0].p


# --- fusion ---
def test_fusion(spark):
    pools = [("bm25", "a", 1), ("bm25", "b", 2), ("exact", "b", 1), ("bm25", "a", 5), ("odd", "c", 1)]
    sch = "signal string, stable_id string, rank int"
    want = {"a": 3 / 61, "b": 3 / 62 + 4 / 61, "c": 1 / 61}
    for order in itertools.islice(itertools.permutations(pools), 0, 120, 40):
        got = {r.stable_id: r.fused_score for r in fusion.rrf(spark.createDataFrame(list(order), sch)).collect()}
        assert got == pytest.approx(want)
    empty = fusion.rrf(spark.createDataFrame([], sch))
    assert empty.count() == 0
    items = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 9, 4, 1, 100, 0])], "g string, i int, s int")
    kept = lambda skip: sorted(r.i for r in fusion.pack_budget(items, ["g"], [F.col("i")], "s", 10, skip).collect())
    assert kept(True) == [0, 2, 3, 5] and kept(False) == [0]
    p = fusion.passages(spark.createDataFrame([(1, "x" * 2000), (2, ""), (3, None), (4, "y" * 900)], "k int, t string"), ["k"], "t").collect()
    assert [(r.k, r.char_start, r.char_end) for r in p] == [(1, 0, 900), (1, 675, 1575), (1, 1350, 2000), (4, 0, 900)]
    with pytest.raises(ValueError):
        Options(rerank="magic")


def test_neighbours(spark):
    rows = spark.createDataFrame([("k", i) for i in range(10)] + [("z", 3)], "k string, s long")
    anchors = spark.createDataFrame([("k", 3, 1), ("k", 5, 2)], "k string, s long, anchor_pos int")
    got = lambda m: sorted((r.s, r.anchor_pos) for r in fusion.neighbours(anchors, rows, "k", "s", 1, m).collect())
    assert got("adjacent") == [(2, 1), (4, 1), (6, 2)] and got("after") == [(4, 1), (6, 2)] and got("off") == []


# --- joins and aggregates ---
def test_joins(spark):
    t = spark.createDataFrame([("t1", "p", "s", "h", "x", 0), ("t2", None, "s", "h2", "x", 100), ("t3", None, None, None, None, None), ("t4", "p", None, "zz", "q", 10**9)], "id string, prompt_id string, session_id string, content_hash string, user_text string, at_us long")
    j = spark.createDataFrame([("j2", "p", "s", "h", "x", 5), ("j1", None, "s", "h9", " x ", 150), ("j3", None, "s", "h2", "y", 0)], t.schema)
    got = {r.id: (r.journal_id, r.rule, r.kind) for r in J.reconcile(t, j, 100).collect()}
    assert got == {"t1": ("j2", 1, "exact"), "t2": ("j3", 2, "exact"), "t3": (None, None, "missing"), "t4": ("j2", 1, "lag")}
    a = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert {(r.x, r.surplus) for r in J.multiset_difference(a, spark.createDataFrame([(1,), (2,)], "x int")).collect()} == {(1, 1), (2, -1), (None, 1)}
    m = J.merge_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), "k", ["v"])
    assert {(r.k, r.v, r.status) for r in m.collect()} == {(1, "a", "kept"), (2, None, "replaced"), (3, "c", "added")}
    facts = J.anchored_facts(spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string"), spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "c")], "fact string, pattern string"), "id", "t")
    assert [tuple(r) for r in facts.collect()] == [(1, "f")]
    many = spark.createDataFrame([(f"f{i}", f"w{i}$") for i in range(40)], "fact string, pattern string")
    J.PATTERNS_PER_PASS, kept = 7, J.PATTERNS_PER_PASS
    assert sorted(r.fact for r in J.anchored_facts(spark.createDataFrame([(1, "w3"), (2, "w39")], "id int, t string"), many, "id", "t").collect()) == ["f3", "f39"]
    J.PATTERNS_PER_PASS = kept


def test_aggregates(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 1, None, 3, 3, 9]] + [("n", None)], "k string, v int")
    for share in (0.0, 0.5, 0.95, 1.0):
        xs = sorted([5, 1, 3, 3, 9])
        want = xs[max(0, min(len(xs), int(math.floor(share * len(xs) + 0.5 + 0.5))) - 1)]
        assert [tuple(r) for r in A.percentile_nearest(df, ["k"], "v", share).collect()] == [("g", want)]
    d = A.dominant(spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b"), ("h", None), ("h", "c"), ("i", "y"), ("i", "x")], "g string, v string"), ["g"], "v", 0.5)
    assert [(r.g, r.v, r.n) for r in d.collect()] == [("g", "a", 2)]


# --- journal ---
def test_journal(spark):
    cols = "source_identity string, prompt_id string, session_id string, source_byte_offset long, source_start_line int, source_end_line int, recorded_at string, sequence long, logical_turn_key string, source_kind string, source_fidelity_rank int, user_text string, assistant_text string"
    rows = [("s", "p", None, None, None, None, "t", 1, None, "rule_write", None, "u", "a"), ("s", "p", None, None, None, None, "t", 2, None, "odd", None, "u", "a"), ("s", None, "x", None, 3, 4, "t", 3, " ", None, 2, None, "a"), (None, None, None, None, None, None, None, 4, None, None, None, None, None)]
    n = JR.normalize_events(spark.createDataFrame(rows, cols))
    got = {r.sequence: (r.idempotency_key, r.logical_turn_key, r.source_fidelity_rank, r.problem) for r in n.collect()}
    assert got[1] == ("s::prompt::p", "p", 3, None) and got[2][2] == 5 and got[3] == ("s::x::0:3:4", "s#3-4", 2, None) and got[4][3] == "no source"
    assert sorted(r.sequence for r in JR.record_once(n.limit(0), n).collect()) == [1, 3, 4]
    chain, prior = [], ""
    for i in range(1, 6):
        r = spark.createDataFrame([(i, f"u{i}", prior)], "sequence long, user_text string, prior_event_hash string").withColumn("event_hash", JR.event_hash(F.col("prior_event_hash"), ["sequence", "user_text"])).first()
        prior = r.event_hash
        chain.append(tuple(r))
    df = spark.createDataFrame(chain, "sequence long, user_text string, prior_event_hash string, event_hash string")
    assert JR.verify_chain(df, ["sequence", "user_text"]).count() == 0
    broken = df.withColumn("user_text", F.when(F.col("sequence") == 3, "forged").otherwise(F.col("user_text"))).where("sequence <> 2")
    assert {r.sequence: (r.bad_link, r.bad_hash) for r in JR.verify_chain(broken, ["sequence", "user_text"]).collect()} == {3: (True, True)}
    gaps = JR.uncovered_ranges(spark.createDataFrame([("s", 5, 10, 1), ("s", 8, 9, 2), ("s", 20, 30, 3)], "g string, a long, b long, u int"), "g", "a", "b", "u")
    assert sorted((r.gap_start, r.gap_end) for r in gaps.collect()) == [(0, 5), (10, 20)]


# --- evaluation ---
def test_metrics(spark):
    labels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("z", "x", 0)], "qid string, doc string, grade int")
    ranked = spark.createDataFrame([("q", "n", 1), ("q", "a", 2), ("q", "a", 3), ("q", "b", 4), ("only", "m", 1)], "qid string, doc string, rank int")
    got = {r.qid: r for r in E.query_metrics(ranked, labels).collect()}
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert got["q"].recall_10 == 1.0 and got["q"].mrr_10 == 0.5 and got["q"].success_1 == 0 and got["q"].success_3 == 1
    assert got["q"].ndcg_10 == pytest.approx((7 / math.log2(3) + 3 / 2) / ideal)
    assert got["z"].recall_10 is None and got["z"].ndcg_10 is None and got["z"].zero_result == 1 and got["only"].zero_result == 0
    assert E.query_metrics(ranked.limit(0), labels.limit(0)).count() == 0


def test_bootstrap():
    r = E.JavaRandom(42)
    assert [r.bits(32), r.bits(32)] == [-1170105035, 234785527]
    r = E.JavaRandom(42)
    assert [r.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]
    for n in (1, 2, 7, 64, 1000, 2**30 + 1):  # the last rejects half of its draws
        r = E.JavaRandom(7)
        assert E.java_draws(7, n, 20_000).tolist() == [r.below(n) for _ in range(20_000)], n
    d = [0.5, -1.0, 2.0, 0.25, 3.0]
    rng = random.Random(1)
    plain = sorted(sum(rng.choices(d, k=5)) / 5 for _ in range(2000))
    assert E.bootstrap_python(d, 2000) == (pytest.approx(0.95), pytest.approx(plain[50]), pytest.approx(plain[1949]), 5)
    r = E.JavaRandom(42)
    plain = sorted(sum(d[r.below(5)] for _ in range(5)) / 5 for _ in range(2000))
    assert E.bootstrap_java(d, 2000) == (pytest.approx(0.95), pytest.approx(plain[49]), pytest.approx(plain[1950]), 5)
    assert E.bootstrap_java([]) == (None, None, None, 0)
    mean, low, high, n = E.bootstrap_java([0.1, -0.2, 0.4, 0.0], 500)
    assert (mean, n) == (pytest.approx(0.075), 4) and low <= mean <= high and E.bootstrap_java([0.1, -0.2, 0.4, 0.0], 500)[1] == low


def test_greedy_coverage(spark):
    pool = [("g", 1, 1, ["aaaaaaa", "x1"]), ("g", 2, 2, ["x1"]), ("g", 3, 3, ["bbbbbbb", "short"]), ("g", 4, 4, ["short"])]
    c = spark.createDataFrame(pool, "g string, id int, sequence long, tokens array<string>")
    freq = spark.createDataFrame([("aaaaaaa", 2), ("x1", 2), ("bbbbbbb", 1)], "token string, df long")
    assert [(r.id, r.pick) for r in E.greedy_coverage(c, ["g"], freq, 10, 5).orderBy("pick").collect()] == [(3, 1), (1, 2)]


# --- vectors ---
def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, [0.0, 0.0]), (3, None), (4, [0.5, 0.5])], "id int, v array<float>")
    q = df.select("id", V.quantize(F.col("v")).alias("q")).select("id", V.dequantize(F.col("q")).alias("d")).collect()
    assert {r.id: r.d for r in q}[3] is None and {r.id: r.d for r in q}[1][1] == pytest.approx(-2.0)
    assert [(r.id, r.score) for r in V.search(df, [[1.0, 1.0]], "id", "v", 5).collect()] == [(4, 1.0), (2, 0.0), (1, -1.0)]
    multi = spark.createDataFrame([("p", [[1.0, 0.0], [0.0, 1.0]]), ("r", [[0.5, 0.5]])], "id string, vs array<array<float>>")
    got = {r.id: r.score for r in V.search(multi, [[1.0, 0.0], [0.0, 1.0]], "id", "vs", 5, multi=True).collect()}
    hof = multi.select("id", V.maxsim(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), F.col("vs")).alias("s")).collect()
    assert got == {r.id: r.s for r in hof} == {"p": 2.0, "r": 1.0}
    assert math.isclose(sum(x * x for x in V.stub_vector("word")), 1.0) and V.stub_vector("Word") == V.stub_vector("word")
