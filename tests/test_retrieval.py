"""Retrieval paths over a small store in which every stage changes the result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvidex.operators import evidence, fts, fusion, passages
from corvidex.operators import retrieval as RT
from corvidex.operators import scorers as S

DAY = dt.datetime(2026, 1, 1)


def turn(i, n, ticket, text, impact="none", day=0):
    path = f"turns/{ticket}/d2026010{1 + day}/plan/impact-{impact}/turn-{n:06d}.md"
    return (i, "convo.db", "chat:turns", path, f"turn-{n:06d}.md", text, f'---\nmode: "plan"\nimpact: "{impact}"\n---\n', DAY + dt.timedelta(days=day))


DOCS = [
    turn(1, 1, "abc1", "## User\n\nABC-1 lease question\n\n## Assistant\n\nThe lease is verified and merged.", "high", 3),
    turn(2, 2, "abc1", "## User\n\nnext\n\n## Assistant\n\nnothing of note"),
    turn(3, 3, "abc1", "## User\n\nwhat is stale in the snippet retrieval\n\n## Assistant\n\nmeta"),
    turn(4, 9, "xyz2", "## User\n\nlease again\n\n## Assistant\n\nlease zone"),
    turn(5, 10, "xyz2", "## User\n\nplain\n\n## Assistant\n\nplain"),
    (6, "worklogs.db", "worklog:state", "abc1/abc1.md", "abc1.md", "## Status\nopen ABC-1\n## Next Action\nlease", "", DAY + dt.timedelta(days=1)),
    (7, "worklogs.db", "worklog:chunks", "abc1/findings/a.md", "a.md", "finding ABC-1 about a lease", 'state: "current"', DAY),
    (8, "worklogs.db", "worklog:chunks", "abc1/status/b.md", "b.md", "status ABC-1", "", DAY),
    (9, "artifacts.db", "chat:artifacts", "tools/x", "x", "lease dump", None, None),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    df = spark.createDataFrame(DOCS, "doc_id long, origin_db string, source string, file_path string, file_name string, text string, content string, indexed_at timestamp")
    df.write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    fts.write_index(fts.index_source(docs, "text", extract=False), f"{path}/index", 4)
    return docs, fts.open_index(spark, f"{path}/index")


def ids(rows):
    return [r.stable_id for r in rows.orderBy("pos").collect()]


def test_neighbours_stand_behind_their_turn_or_behind_the_list(spark, store):
    docs, _ = store
    ranked = spark.createDataFrame([(4, 1), (7, 2), (1, 3)], "stable_id long, pos int")
    assert ids(RT.expand(docs, ranked, "text")) == [4, 5, 7, 1, 2]
    assert ids(RT.expand(docs, ranked, "text", 1, "after")) == [4, 7, 1, 5, 2]
    assert ids(RT.expand(docs, ranked, "text", 2, allow_meta=True)) == [4, 5, 7, 1, 2, 3] and ids(RT.expand(docs, ranked, "text", 0)) == [4, 7, 1]
    assert ids(RT.expand(docs, ranked, "text", 2)) == [4, 5, 7, 1, 2]  # a turn about retrieval is no neighbour


def test_systems_differ_and_capsule_is_pinned(store):
    docs, index = store
    # S0 asks for all words and has no neighbours, S1 relaxes
    o = RT.SYSTEMS
    strict = RT.topic_list(docs, index, "lease zone", o["S0"])
    assert ids(strict.rows) == [4] and strict.form == "strict"
    loose = RT.topic_list(docs, index, "lease zone", o["S1"])
    assert loose.form == "relaxed" and {1, 4, 5, 6, 7, 9} <= set(ids(loose.rows))
    pinned = RT.topic_list(docs, index, "ABC-1 lease verified")
    assert ids(pinned.rows)[0] == 6 and pinned.degraded is None


class Absent(S.OverlapScorer):
    def check(self):
        raise S.ScorerUnavailable("no model here")


class Silent(S.OverlapScorer):
    def score(self, query, texts):
        return [None] * len(texts)


def test_rerank_degrades_to_the_given_order(spark, store, tmp_path):
    docs, index = store
    base = ids(RT.topic_list(docs, index, "lease zone", RT.SYSTEMS["S1"]).rows)
    for scorer, why in ((Absent(), "no model here"), (Silent(), "too few scored")):
        found = RT.topic_list(docs, index, "lease zone", RT.Options(), scorer=scorer)
        assert found.degraded == why and ids(found.rows) == base
    with pytest.raises(S.ScorerUnavailable):
        S.CrossEncoderScorer(str(tmp_path), {}).check()
    (tmp_path / "model.onnx").write_bytes(b"x")
    with pytest.raises(S.ScorerUnavailable, match="not the one"):
        S.CrossEncoderScorer(str(tmp_path), {"model.onnx": "0"}).check()
    cut = RT.topic_list(docs, index, "lease zone", RT.SYSTEMS["S6"])
    assert ids(cut.rows)[0] == 4  # both words in one passage


def test_ticket_pools_and_stale_state(store):
    docs, index = store
    rows = {r.doc_id: r for r in RT.ticket_candidates(docs, index, "abc-1").collect()}
    assert rows[6].pool == "state" and rows[6].freshness == "stale" and rows[1].pool == "newer-evidence"
    assert [i for i, r in sorted(rows.items(), key=lambda x: x[1].place)][:4] == [6, 1, 8, 7]  # status before findings
    out = RT.ticket_result(docs, index, "abc-1", "lease").orderBy("position").collect()
    assert {r.doc_id for r in out} >= {6, 1, 2, 7, 8} and len({r.doc_id for r in out}) == len(out)
    assert [r.position for r in RT.ticket_context(docs, index, "abc-1", budget=120).orderBy("position").collect()] == list(range(1, 1 + RT.ticket_context(docs, index, "abc-1", budget=120).count()))
    assert RT.ticket_result(docs, index, "NONE-9").count() == 0


def test_route_and_coverage(spark, store):
    docs, index = store
    freq = RT.token_frequencies(docs)
    # a generic question about a ticket: its turns are chosen by what they cover
    found = RT.topic_list(docs, index, "ABC-1 current status", RT.Options(), frequencies=freq)
    pools = {r.stable_id: r.pool for r in found.rows.collect()}
    assert pools[1] == "coverage" and pools[6] == "ranked"
    ranked = spark.createDataFrame([(7, 1), (1, 2), (9, 3), (4, 4)], "stable_id long, pos int")
    chat = spark.createDataFrame([(1,), (4,)], "doc_id long")
    chosen = spark.createDataFrame([(2, 1), (3, 2), (5, 3)], "doc_id long, pick int")
    assert ids(RT.splice(ranked, chat, chosen)) == [7, 2, 9, 3, 5, 1, 4]
    name, n = RT.dominant_ticket(docs, spark.createDataFrame([(4, 1), (1, 2), (2, 3)], "stable_id long, pos int"))
    assert (name, n) == ("abc1", 2)


def test_resume_takes_the_recent_turns_first(store):
    docs, _ = store
    rows = RT.resume(docs).orderBy("position").collect()
    assert [r.doc_id for r in rows[:5]] == [5, 4, 3, 2, 1] and {r.doc_id for r in rows} >= {6, 7, 8, 9}
    assert RT.resume(docs.limit(0)).count() == 0


def test_passages(spark):
    long = "word " * 400
    rows = [(1, "d", "chat:turns", "turns/abc1/x", f"intro\n## User\n\nask\n\n## Assistant\n{long}\n## Details\n \n", '---\nmode: "plan"\ntimestamp: "2026-01-02T10:00"\n---\n'),
            (2, "d", "worklog:state", "abc1.md", "before\n## Next Action!\nx\n## B\n", None), (3, "d", "notes", None, "x" * 901, None), (4, "d", "chat:turns", "p", "no heads", None), (5, "d", "notes", "p", None, None), (6, "d", "notes", "p", " \n ", None)]
    df = spark.createDataFrame(rows, "doc_id long, origin_db string, source string, file_path string, text string, content string")
    got = passages.structured_passages(df).orderBy("doc_id", "char_start").collect()
    assert [(r.doc_id, r.section) for r in got] == [(1, "user"), *[(1, "assistant")] * 3, (2, "state"), (2, "state-next-action-"), (3, "chunk"), (3, "chunk"), (4, "turn")]
    assert got[0].passage.startswith("ticket=abc1 date=2026-01-02 mode=plan section=user\n") and "ask" in got[0].passage
    for r in got:
        body = rows[r.doc_id - 1][4]
        assert r.passage.split("\n", 1)[1] == body[r.char_start : r.char_end] and r.n_tokens == (len(r.passage) + 3) // 4
    assert len({r.passage_id for r in got}) == len(got)
    best = passages.best_passages(passages.structured_passages(df), ["nothing"], 2).collect()
    assert sorted((r.doc_id, r.found) for r in best) == [(1, 0), (2, 0), (2, 0), (3, 0), (3, 0), (4, 0)]


def test_freshness(spark):
    said = "## User\nsee KEY-1\n## Assistant\nmerged"
    ev = spark.createDataFrame([("KEY-1", 10, "exact", said), ("KEY-1", 30, "local", said), ("KEY-1", 99, "date_only", said), ("KEY-1", 98, "exact", "KEY-1 merged"), ("K-2", 5, "exact", "## User\nK2\n## Assistant\nready"), ("K-3", 5, "exact", "## User\nK-3 snippet\n## Assistant\nready"), ("K-4", None, "exact", said)], "ticket string, event_us long, confidence string, body string")
    ch = spark.createDataFrame([("KEY-1", 20), ("KEY-1", 15), ("K-3", 1), ("K-9", None)], "ticket string, latest_us long")
    got = {r.ticket: (r.freshness, r.authoritative_through, r.evidence_through, r.newer) for r in evidence.classify(ev, ch).collect()}
    assert got == {"KEY-1": ("stale", 20, 30, 1), "K-2": ("undetermined", None, 5, 0), "K-3": ("fresh", 1, None, 0), "K-9": ("undetermined", None, None, 0)}
    assert fusion.rrf(spark.createDataFrame([], "signal string, stable_id long, rank int")).count() == 0 and F is not None
