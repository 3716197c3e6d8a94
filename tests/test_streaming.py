from datetime import datetime

from pyspark.sql import functions as F

from corvidex.streaming import journal as S


def test_recording_projection_and_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "idempotency_key string, event_time timestamp, sequence long, user_text string, assistant_text string, tier string"
    t = lambda m: datetime(2026, 1, 1, 10, m)
    rows = [("k1", t(0), 1, "u", "a", None), ("k1", t(1), 2, "u", "a", None), ("k2", t(7), 3, "u", "x" * 50, None), ("k3", t(9), 4, "ok", "", "dross")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = S.read_parquet_stream(spark, src, spark.read.parquet(src).schema)
    S.run_available(S.record_stream(stream), str(tmp_path / "c1"), S.projecting_sink(out, 60))
    got = sorted((r.sequence, r.tier) for r in spark.read.parquet(out).collect())
    assert len(got) == 3 and got[-2:] == [(3, "artifacts"), (3, "turns")]
    counts = []
    S.run_available(S.windowed_counts(stream, "event_time", "5 minutes", []), str(tmp_path / "c2"), lambda b, i: counts.extend(b.collect()), "complete")
    assert {(r.start.minute, r.n) for r in counts} >= {(0, 2), (5, 2)}
    spans = []
    S.run_available(S.sessions(stream, "event_time", "3 minutes", ["user_text"]), str(tmp_path / "c3"), lambda b, i: spans.extend(b.collect()), "complete")
    assert sorted((r.user_text, r.n) for r in spans) == [("ok", 1), ("u", 1), ("u", 2)]


def test_turn_tail(spark, tmp_path):
    src, ck, seen = str(tmp_path / "in"), str(tmp_path / "c"), []
    schema = "sessionid string, record_no long, role string, text string"
    spark.createDataFrame([("s", 1, "user", "q1"), ("s", 2, "assistant", "a1"), ("s", 3, "assistant", "a2")], schema).coalesce(1).write.parquet(src)
    go = lambda: S.run_available(S.turn_tail(S.read_parquet_stream(spark, src, spark.read.parquet(src).schema)), ck, lambda b, i: seen.extend(b.collect()))
    go()
    assert seen == []  # the turn may still grow
    spark.createDataFrame([("s", 4, "user", "q2"), ("s", 5, "user", "q3"), ("s", 6, "assistant", "a3")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert [(r.turn, r.user_text, r.assistant_text) for r in seen] == [(1, "q1", "a1\na2")]


def test_resume_and_index(spark):
    import hashlib

    f = spark.createDataFrame([("a", b"hello world"), ("b", b"short"), ("c", b"new"), ("d", b"changed!")], "path string, content binary")
    h = lambda b: hashlib.sha256(b).hexdigest()
    st = spark.createDataFrame([("a", 5, h(b"hello"), 2), ("b", 50, h(b"x"), 2), ("d", 3, h(b"old"), 2)], "path string, byte_offset long, prefix_hash string, parser_version int")
    assert {r.path: r.resume_at for r in S.resume_offsets(f, st, 2).collect()} == {"a": 5, "b": 0, "c": 0, "d": 0}
    assert all(r.full_rescan for r in S.resume_offsets(f, st, 3).collect())
    todo, gone = S.incremental_index(spark.createDataFrame([(1, "x"), (2, "y")], "k int, h string"), spark.createDataFrame([(1, "x"), (2, "old"), (3, "z")], "k int, h string"), "k", "h")
    assert [r.k for r in todo.collect()] == [2] and [r.k for r in gone.collect()] == [3]
    assert S.change_stamp(f.select(F.length("path").alias("n")), "n") == "4:1"
