"""Registered queries over tables in which a cut would leave something out."""

from corvidex.queries import analysis, ingest, relational, retrieval


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_turns_delivered_often_are_emitted(spark, tmp_path):
    rows = [(i, "hot" if i <= 49 else "cold") for i in range(1, 52)] + [(60, None)]
    d = write(spark, tmp_path, "journal_observations", rows, "sequence long, turn_hash string")
    got = {r.sequence: r.kind for r in ingest.QUERIES["snk_turn_emit"](spark, d).collect()}
    assert got == {i: "turn" if i in (1, 50) else "sighting" for i in range(1, 52)}


def test_digest_weighs_rows_older_than_the_newest_200(spark, tmp_path):
    rows = [(1, 0, "old", "x" * 50)] + [(i, 1, f"h{i}", "y" * 9_000_000) for i in (2,)] + [(i, 2, f"h{i}", "z") for i in range(3, 260)]
    d = write(spark, tmp_path, "journal_observations", rows, "sequence long, source_fidelity_rank int, turn_hash string, assistant_text string")
    got = {r.position: r.used_before for r in retrieval.QUERIES["rnk_digest_assemble"](spark, d).collect()}
    assert got[1] == 0 and 2 not in got and len(got) == 258


def test_packing_and_lookup_reach_every_document(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", "x" * (2000 if i < 900 else 1000)) for i in range(1, 1001)]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, source string, content string")
    write(spark, tmp_path, "embeddings", [(950, 3)], "vec_id long, label int")
    got = sorted(tuple(r) for r in analysis.QUERIES["rnk_pack"](spark, d).collect())
    assert got == [("a", 1), ("a", 901), ("b", 2), ("b", 900)]
    found = {r.doc_id: r.cached for r in relational.QUERIES["join_cache_lookup"](spark, d).collect()}
    assert len(found) == 1000 and found[950] == 3


def test_bootstrap_takes_every_user(spark, tmp_path):
    rows = [(2 * u + k, u, "e", float(u * k)) for u in range(60) for k in (0, 1)]
    d = write(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, value double")
    assert analysis.QUERIES["ev_bootstrap"](spark, d).first().pairs == 60
    assert analysis.QUERIES["ev_bootstrap_py"](spark, d).first().pairs == 60
