"""Registered functions, ticket capsules, gold sets and request checks: their edges."""

import json

import pytest
from pyspark.sql import functions as F

from corvidex.functions.registered import register
from corvidex.operators import evaluation as E
from corvidex.operators import gold, journal, tickets
from corvidex.sources import protocol, sinks

BAR = "=" * 80


def test_table_functions_take_nulls(spark):
    register(spark)
    spark.createDataFrame([(1, None), (2, ""), (3, "x" * 1000)], "id int, t string").createOrReplaceTempView("edge_texts")
    for name, n in (("split_passages", 2), ("parse_chatlog", 1), ("parse_worklog", 1)):
        assert spark.sql(f"SELECT id, x.* FROM edge_texts, LATERAL {name}(t) x").count() == n, name
    spark.createDataFrame([(1, None), (2, b""), (3, b"no zip")], "id int, t binary").createOrReplaceTempView("edge_bytes")
    assert spark.sql("SELECT id FROM edge_bytes, LATERAL zip_entries(t)").count() == 0
    got = spark.sql("SELECT overlap_score('a B', t), zlib_inflate(zlib_deflate(t)) FROM edge_texts WHERE id < 3 ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(0.0, None), (0.0, "")]


def test_capsules(spark):
    rows = [("A-1", "status", "f1", 0, 1, "STATUS", "old"), ("A-1", "status", "f2", 0, 1, "STATUS", "new"), ("A-1", "findings", "f2", 1000, 9, "FINDINGS", "ż" * 9000), ("A-1", "blockers", "f2", 0, 1, "STATUS", "same lines"),
            ("A-1", "other", "f2", 5, 50, "X", "not in a capsule"), (None, "status", "f", 0, 1, "S", "no ticket"), ("B-2", "summary", "f", 0, 1, "S", None)]
    df = spark.createDataFrame(rows, "ticket string, category string, source_path string, source_order int, start_line int, heading string, body string").withColumn("place", F.lit("clash"))
    got = {r.ticket: r for r in tickets.capsules(df).collect()}
    assert set(got) == {"A-1", "B-2"} and got["A-1"].n_sections == 2 and "same lines" not in got["A-1"].markdown
    text = got["A-1"].markdown
    assert len(text.encode()) <= tickets.CAPSULE_BYTES and text.endswith("ż…") and "## status\nnew" in text and "old" not in text
    index = {r.ticket: (r.n_chunks, r.n_sources, r.categories) for r in tickets.ticket_index(df).collect()}
    assert index["A-1"] == (5, 2, "blockers,findings,other,status")
    assert tickets.capsules(df.limit(0)).count() == 0


def test_active_tickets(spark):
    states = [{"ticket_key": "A-1", "lifecycle": "open", "updated_at": "1", "blockers": [{"status": "resolved"}, {"status": "open"}, {}]}, {"ticket_key": "A-1", "lifecycle": "Closed", "updated_at": "2"}, {"ticket_key": "B-2", "phase": "plan"}, {"ticket_key": " "}]
    df = spark.createDataFrame([(json.dumps(x),) for x in states] + [(None,), ("[",)], "text string")
    assert [(r.ticket, r.phase, r.n_blockers) for r in tickets.active_tickets(df).collect()] == [("B-2", "plan", 0)]
    first = df.where(F.col("text").contains('"1"'))
    assert [(r.ticket, r.n_blockers) for r in tickets.active_tickets(first).collect()] == [("A-1", 2)]


def test_gold_sets(spark, tmp_path):
    words = ["", "a", "hello", "Zażółć gęślą", "polygenelubricants", "\U0001f600 x"]
    want = [0, 97, 99162322, None, -2147483648, None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(gold.java_hash(F.col("w"))).collect()]

    def java(text):
        h = 0
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    assert got == [java(w) if x is None else x for w, x in zip(words, want)]
    state = {"ticket_key": "AB-1", "next_action": "wait", "decisions": [{"id": "1", "description": "keep the  retry budget at three."}, {"id": "2", "description": None}], "blockers": [{"description": "kolejka jest pełna zawsze"}]}
    made = {r.qid: r for r in gold.candidates(spark.createDataFrame([(json.dumps(state),), ("x",), (None,)], "text string")).collect()}
    assert set(made) == {"c-AB-1-decision0q", "c-AB-1-decision0k", "c-AB-1-blocker1q", "c-AB-1-blocker1k"}
    assert made["c-AB-1-decision0q"].query == "What did we decide about keep the retry budget at three.?" and made["c-AB-1-decision0k"].query == "keep retry budget"
    assert made["c-AB-1-blocker1q"].lang == "pl" and made["c-AB-1-blocker1q"].query.startswith("Co blokuje kolejka")
    sch = "qid string, query string, labels array<struct<doc:string,rel:int>>"
    old = spark.createDataFrame([("1", "a", []), ("2", "b", [("d", 3)]), ("3", "c", None)], sch)
    new = spark.createDataFrame([("2", "B", []), ("3", "c", None), ("4", "d", []), ("4", "e", [])], sch)
    for replace, gone in ((False, "kept"), (True, "removed")):
        assert {r.qid: r.status for r in gold.import_set(old, new, replace).collect()} == {"1": gone, "2": "updated", "3": "unchanged", "4": "added"}
    s = gold.status(old).first()
    assert (s.questions, s.labelled, s.g3) == (3, 1, 1)
    gold.save_version(old, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="already exists"):
        gold.save_version(old, str(tmp_path / "v"), "1")


def test_coverage_measures(spark):
    present = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "a", 2), ("t", "c", 3), ("u", "a", 2)], "task string, fact string, rank int")
    facts = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 1.0), ("t", "c", 5.0), ("u", "a", 2.0), ("v", "a", 1.0)], "task string, fact string, weight double")
    got = {r.task: r for r in E.ndcg_coverage(present, facts).collect()}
    assert got["t"].dcg == pytest.approx(2 + 5 / 2) and got["t"].ideal == pytest.approx(5 + 2 / 1.584962500721156) and set(got) == {"t", "u"}
    ranked = spark.createDataFrame([("t", 1), ("t", 2), ("t", 3), ("t", 4), ("u", 1), ("u", 2)], "task string, rank int")
    assert {r.task: r.precision_2 for r in E.precision_proxy(present, ranked, (2,)).collect()} == {"t": 1.0, "u": 0.5}
    ledger = spark.createDataFrame([("t", 2, "b", 2.0, ["x", "y", "z.*"]), ("t", 1, "a", 5.0, ["only"]), ("t", 3, "c", 1.0, ["p", "q"]), ("t", 4, "d", 3.0, ["m", "n"])], "task string, place int, fact string, weight double, words array<string>")
    assert sorted((r.fact, r.query) for r in E.needles(ledger, 1).collect()) == [("b", "x y")]


def test_requests(spark):
    rows = [(1, "p", "s", 0, 5, 1, "text"), (1, "p", "s", 0, 5, 1, "text"), (2, "q", None, -1, 5, None, "x" * 4001), (3, "r", "s", 0, 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, passage_id string, section string, char_start int, char_end int, n_tokens int, passage string")
    got = sorted((r.doc_id, r.problem.split()[0]) for r in protocol.passage_problems(df).collect())
    assert got == [(1, "passage"), (2, "a"), (2, "char_start"), (2, "n_tokens"), (2, "section"), (3, "each")]
    many = spark.range(450).selectExpr("id as doc_id", "'s' as section").union(spark.range(30).selectExpr("999 as doc_id", "'s' as section"))
    per = {r.batch: r["count"] for r in protocol.request_batches(many, 200, 20).groupBy("batch").count().collect()}
    assert per == {0: 200, 1: 200, 2: 50, None: 1}


def test_staging_renaming_and_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "out_path string, hash string")
    b = spark.createDataFrame([("y", "2"), ("w", "3"), ("z", "9")], "out_path string, hash string")
    assert {r.out_path: r.action for r in sinks.stage_plan(a, b).collect()} == {"x": "write", "y": "keep", "z": "write", "w": "delete"}
    docs = spark.createDataFrame([(1, "d.db", "old"), (2, "e.db", "old"), (3, "d.db", "kept"), (4, None, "old"), (5, None, None)], "doc_id long, origin_db string, source string")
    sinks.insert_documents(docs, str(tmp_path / "s"))
    sinks.rename_archive(spark, str(tmp_path / "s"), "old", "new")
    assert sorted((r.doc_id, r.source) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, "new"), (2, "new"), (3, "kept"), (4, "new"), (5, None)]
    raw = spark.createDataFrame([("s", b"\x00\xff"), ("s", b"\x00\xff"), ("t", b"\x00\xff"), ("s", None)], "source_identity string, content binary")
    first = journal.snapshots(raw.where("source_identity = 's'"))
    assert first.count() == 1 and {r.source_identity for r in journal.snapshots(raw, first).collect()} == {"t"}
