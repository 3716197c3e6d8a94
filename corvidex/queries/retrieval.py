"""Queries of the retrieval paths and what is left of the pools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import evaluation as E
from corvidex.operators import evidence as EV
from corvidex.operators import fts, fusion, passages
from corvidex.operators import retrieval as RT
from corvidex.operators import scorers as SC
from corvidex.operators import vectors as V
from corvidex.queries.common import Registry, kept_table, sql_tokens, text_index
from corvidex.queries.relational import _MATERIAL_SQL, docs, journal
from corvidex.queries.search import _f1 as f1_sql
from corvidex.queries.search import _ranked as ranked_sql
from corvidex.session import load_table
from corvidex.sources import worklog

R = Registry()
q = R.query
_AUTH = "CASE source WHEN 'worklog:state' THEN 0 WHEN 'worklog:chunks' THEN 1 WHEN 'chat:turns' THEN 2 ELSE 3 END"


def _pool(where: str, order: str, n: int = 50) -> str:
    return f"SELECT doc_id, row_number() OVER (ORDER BY {order}) AS rank FROM documents WHERE {where} QUALIFY rank <= {n}"


_TURNS = _pool("source = 'chat:turns'", "doc_id DESC")


def _ranks(p: DataFrame) -> DataFrame:
    return p.select(F.col("stable_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


q("rnk_pool_exact", _pool("list_contains(string_split(lower(file_path), '/'), 'turns')", f"{_AUTH}, doc_id DESC"))(lambda s, d: _ranks(RT.pool_exact(docs(s, d), "TURNS")))
q("rnk_pool_recency", _pool("source = 'chat:turns'", "doc_id DESC"))(lambda s, d: _ranks(RT.pool_recency(docs(s, d))))
q("rnk_pool_authority", _pool("source IN ('worklog:state', 'worklog:chunks')", f"{_AUTH}, doc_id DESC"))(lambda s, d: _ranks(RT.pool_authority(docs(s, d))))
q("rnk_pool_impact", _pool(r"regexp_matches(content, '(?m)^impact: \"?high\"?\s*$')", "doc_id DESC"))(lambda s, d: _ranks(RT.pool_impact(docs(s, d))))
q("rnk_pool_artifact", _pool("source = 'chat:artifacts'", "doc_id DESC"))(lambda s, d: _ranks(RT.pool_artifact(docs(s, d))))


@q("rnk_pool_late", "WITH x AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), z AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(list_zip(e.embedding, x.embedding), lambda v: v[1]::DOUBLE * v[2]::DOUBLE)), 4) AS score FROM embeddings e, x) SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= 50")
def rnk_pool_late(s, d):
    e = load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return _ranks(RT.pool_late(e, [list(e.orderBy("doc_id").first().vector)]))


@q("top_maxsim", "WITH x AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_sum(list_transform(list_zip(e.embedding, x.embedding), lambda v: v[1]::DOUBLE * v[2]::DOUBLE)), 4) AS score FROM embeddings e, x ORDER BY score DESC, vec_id LIMIT 10")
def top_maxsim(s, d):
    e = load_table(s, d, "embeddings")
    return V.search(e, [list(e.orderBy("vec_id").first().embedding)], "vec_id", "embedding", 10)


q("rnk_stable_id", "SELECT doc_id, concat_ws(':', origin_db, source, file_path) AS stable_id FROM documents")(lambda s, d: docs(s, d).select("doc_id", fusion.stable_id().alias("stable_id")))
q("rnk_add_signal", f"WITH a AS ({_TURNS}) SELECT doc_id, round(2.0 / (60 + rank) + 3.0 / (60 + doc_id), 9) AS fused_score FROM a")(lambda s, d: _added(s, d))


def _added(s: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(RT.pool_recency(docs(s, d)))
    extra = docs(s, d).select(F.col("doc_id").alias("stable_id"), F.col("doc_id").alias("rank"))
    return fusion.add_signal(fused, extra, 3.0).select(F.col("stable_id").alias("doc_id"), F.round("fused_score", 9).alias("fused_score"))


def _fused(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fused = fusion.rrf(RT.pool_recency(docs(s, d)))
    return fused, RT.overlap_scores(docs(s, d), fused, ["cursor", "lease"], "text")


@q("rnk_fuse_mode")
def rnk_fuse_mode(s, d):
    """The three ways of applying model scores."""
    fused, scores = _fused(s, d)
    out = [fusion.rerank(fused, scores, m).select(F.lit(m).alias("mode"), "stable_id", F.round("fused_score", 6).alias("fused_score")) for m in ("rrf", "score", "cut")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@q("top_rerank")
def top_rerank(s, d):
    fused, scores = _fused(s, d)
    return fusion.rerank(fused, scores, "cut").orderBy(F.col("cut_rank").asc_nulls_last(), "stable_id").limit(20).select("stable_id", "cut_rank")


@q("rnk_rerank_late", "WITH x AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT doc_id FROM documents WHERE source = 'chat:turns' ORDER BY doc_id DESC LIMIT 50) SELECT vec_id, round(list_sum(list_transform(list_zip(e.embedding, x.embedding), lambda v: v[1]::DOUBLE * v[2]::DOUBLE)), 4) AS score FROM embeddings e, x WHERE vec_id IN (SELECT doc_id FROM c)")
def rnk_rerank_late(s, d):
    """Only the candidates (fifty at most) are scored with vectors."""
    e = load_table(s, d, "embeddings")
    cand = RT.pool_recency(docs(s, d)).select(F.col("stable_id").alias("vec_id"))
    return V.search(e.join(F.broadcast(cand), "vec_id", "left_semi"), [list(e.orderBy("vec_id").first().embedding)], "vec_id", "embedding", 100)


@q("ev_needles", f"WITH r0 AS ({ranked_sql([f1_sql('cursor'), f1_sql('gap')], 'f0 > 0 AND f1 > 0')}), t AS (SELECT doc_id FROM r0 ORDER BY score, origin_db, doc_id LIMIT 10) SELECT 'gap' AS fact, 'cursor gap' AS query, coalesce(max(regexp_matches(text, 'without a gap')::INT), 0) AS hit FROM documents WHERE doc_id IN (SELECT doc_id FROM t)")
def ev_needles(s, d):
    """Questions made of the words of known facts, and whether the first ten hits hold the fact."""
    ledger = s.createDataFrame([("t", 1, "gap", 2.0, ["cursor", "gap", "a.*b"]), ("t", 2, "light", 1.0, ["x", "y"]), ("t", 3, "short", 3.0, ["one"])], "task string, place int, fact string, weight double, words array<string>")
    strict = {"gap": "without a gap"}
    out = None
    for r in E.needles(ledger).collect():  # a few questions, each a search of its own
        top = fts.best(text_index(s, d).search(r.query).withColumn("score", F.round("score", 6)), 10).select("doc_id")
        found = docs(s, d).join(F.broadcast(top), "doc_id", "left_semi").agg(F.coalesce(F.max(F.col("text").rlike(strict[r.fact]).cast("int")), F.lit(0)).alias("hit"))
        row = found.select(F.lit(r.fact).alias("fact"), F.lit(r.query).alias("query"), "hit")
        out = row if out is None else out.unionByName(row)
    return out


q("rnk_pool_bm25_relaxed", f"WITH r0 AS ({ranked_sql([f1_sql('zonetable'), f1_sql('zonet', True)], 'f0 > 0 OR f1 > 0')}) SELECT doc_id, row_number() OVER (ORDER BY score, origin_db, doc_id) AS rank FROM r0 QUALIFY rank <= 50")(
    lambda s, d: _ranks(fusion.ranked_pool(text_index(s, d).search("zonetable OR zonet*").withColumn("score", F.round("score", 6)), "bm25_relaxed", [F.col("score"), F.col("origin_db"), F.col("doc_id")], 50, "doc_id"))
)


@q("join_fts_docs", f"SELECT doc_id, file_path FROM documents WHERE list_contains({sql_tokens('text')}, 'lease')")
def join_fts_docs(s, d):
    """Hits of the index joined to their documents."""
    hits = text_index(s, d).search("content:lease")
    return docs(s, d).select("doc_id", "file_path").join(hits.select("doc_id"), "doc_id", "left_semi")


@q("fts_relax_trigger")
def fts_relax_trigger(s, d):
    """Whether the relaxed form runs: few strict hits and no explicit syntax."""
    index = text_index(s, d)
    rows = [(w, index.search(w).limit(10).count() < 10) for w in ("cursor", "quaggaphobia")]
    return s.createDataFrame(rows, "query string, relaxed boolean")


def _frequencies(s: SparkSession, d: str) -> DataFrame:
    return kept_table(s, d, "documents", "token-df", RT.token_frequencies)


def _busiest(s: SparkSession, d: str) -> str:
    """The ticket with most turns (the smallest of several)."""
    turns = RT.turn_columns(docs(s, d).where("source = 'chat:turns'")).where("ticket <> ''")
    row = turns.groupBy("ticket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ticket").first()
    return row.ticket if row else "noticket"


@q("rnk_topic_search")
def rnk_topic_search(s, d):
    """Plan, pools, fusion, re-ranking by passages, neighbours, packing."""
    return RT.topic_search(docs(s, d), text_index(s, d), "where does the cursor lease stall", frequencies=_frequencies(s, d))


@q("rnk_topic_route_search")
def rnk_topic_route_search(s, d):
    """The same with routing to a dominant ticket, and a generic question about a ticket, answered by coverage."""
    o = RT.Options(route=True, limit=15)
    one = RT.topic_search(docs(s, d), text_index(s, d), "where does the cursor lease stall", o, frequencies=_frequencies(s, d))
    key = re.sub(r"(\d+)", r"-\1", _busiest(s, d)).upper()
    two = RT.topic_search(docs(s, d), text_index(s, d), f"{key} current status", o, frequencies=_frequencies(s, d))
    return one.withColumn("asked", F.lit("topic")).unionByName(two.withColumn("asked", F.lit("ticket")))


@q("rnk_resume")
def rnk_resume(s, d):
    """Recent turns and what belongs to the ticket most of them have."""
    return RT.resume(docs(s, d))


q("rnk_ticket_result", None)(lambda s, d: RT.ticket_result(docs(s, d), text_index(s, d), _busiest(s, d), "lease OR cursor"))
q("rnk_ticket", None)(lambda s, d: RT.ticket_candidates(docs(s, d), text_index(s, d), _busiest(s, d)))
q("rnk_ticket_context", None)(lambda s, d: RT.ticket_context(docs(s, d), text_index(s, d), _busiest(s, d)))
_TICKET = r"regexp_extract(coalesce(text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b')"
_USER_PART = r"CASE WHEN contains(coalesce(text, ''), '## User') THEN regexp_extract(text, '(?s)## User\s*(.*?)(?:\n## Assistant|\z)', 1) ELSE %s END"
_EVIDENCE = f"""e AS (SELECT doc_id, file_path, {_TICKET} AS ticket, epoch_us(indexed_at) AS event_us, upper({_USER_PART % "''"}) AS said,
  regexp_matches(coalesce(text, ''), '{_MATERIAL_SQL}') AS material, regexp_matches({_USER_PART % "coalesce(text, '')"}, '{EV.RETRIEVAL_META}') AS meta FROM documents WHERE source = 'chat:turns'),
 relevant AS (SELECT * FROM e WHERE ticket <> '' AND event_us IS NOT NULL AND material AND NOT meta AND (contains(said, ticket) OR contains(said, replace(ticket, '-', ''))))"""


def _first_ticket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ticket", F.get(T.tickets(F.col("text")), F.lit(0))).where("ticket is not null")


@q(
    "rnk_freshness_classify",
    f"""WITH {_EVIDENCE}, c AS (SELECT {_TICKET} AS ticket, max(epoch_us(indexed_at)) AS authoritative_through FROM documents WHERE source LIKE 'worklog:%' GROUP BY 1 HAVING ticket <> ''),
 t AS (SELECT ticket, max(event_us) AS evidence_through FROM relevant GROUP BY 1), n AS (SELECT ticket, count(*) AS newer FROM relevant JOIN c USING (ticket) WHERE event_us > authoritative_through GROUP BY 1)
 SELECT ticket, CASE WHEN authoritative_through IS NULL THEN 'undetermined' WHEN newer > 0 THEN 'stale' ELSE 'fresh' END AS freshness, authoritative_through, evidence_through, coalesce(newer, 0) AS newer
 FROM c FULL JOIN t USING (ticket) LEFT JOIN n USING (ticket)""",
)
def rnk_freshness_classify(s, d):
    """State of every ticket of the worklogs or of evidence."""
    rows = _first_ticket(docs(s, d).withColumn("event_us", F.unix_micros("indexed_at")))
    turns = rows.where("source = 'chat:turns'").select("ticket", "event_us", F.lit("exact").alias("confidence"), F.col("text").alias("body"))
    return EV.classify(turns, rows.where("source like 'worklog:%'").select("ticket", F.col("event_us").alias("latest_us")))


@q("rnk_freshness_label", f"WITH {_EVIDENCE}, c AS (SELECT {_TICKET} AS ticket, max(epoch_us(indexed_at)) AS through FROM documents WHERE source LIKE 'worklog:%' GROUP BY 1) SELECT doc_id, CASE WHEN event_us > through THEN 'newer-evidence' ELSE 'known' END AS label FROM relevant JOIN c USING (ticket)")
def rnk_freshness_label(s, d):
    """Turns that are evidence of a ticket with a state: newer than it, or known to it."""
    rows = _first_ticket(docs(s, d).withColumn("event_us", F.unix_micros("indexed_at")))
    turns = rows.where("source = 'chat:turns' and event_us is not null")
    turns = turns.where(EV.names_ticket(F.col("text"), F.col("ticket")) & EV.is_material(F.col("text")) & ~EV.is_retrieval_meta(F.col("text")))
    through = rows.where("source like 'worklog:%'").groupBy("ticket").agg(F.max("event_us").alias("through"))
    return turns.join(through, "ticket").select("doc_id", F.when(F.col("event_us") > F.col("through"), "newer-evidence").otherwise("known").alias("label"))


_SPLIT = r"""b AS (SELECT doc_id, origin_db, source, file_path, content, regexp_replace(text, '^---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|$)', '') AS body FROM documents WHERE length(text) > 0),
 l AS (SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b WHERE source IN ('chat:turns', 'worklog:state')),
 o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS off FROM l),
 h AS (SELECT doc_id, off, lead(off) OVER (PARTITION BY doc_id ORDER BY off) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY off) AS k FROM o
  WHERE CASE source WHEN 'chat:turns' THEN regexp_matches(line, '^## (User|Assistant|Details)\s*$') ELSE regexp_matches(line, '^## .+$') END),
 q AS (SELECT b.*, off, k, substring(body, (off + 1)::BIGINT, (coalesce(nxt, length(body)) - off)::BIGINT) AS raw FROM b JOIN h USING (doc_id)),
 g AS (SELECT *, CASE source WHEN 'chat:turns' THEN regexp_extract(raw, '(?m)^## (User|Assistant|Details)\s*$', 0) ELSE regexp_extract(raw, '(?m)^## (.+)$', 0) END AS head,
  CASE source WHEN 'chat:turns' THEN lower(regexp_extract(raw, '(?m)^## (User|Assistant|Details)\s*$', 1)) ELSE 'state-' || regexp_replace(lower(trim(regexp_extract(raw, '(?m)^## (.+)$', 1))), '[^a-z0-9]+', '-', 'g') END AS section FROM q),
 s AS (SELECT doc_id, origin_db, source, file_path, content, section, off + length(head) AS begin_at, substring(raw, length(head) + 1) AS part FROM g
  UNION ALL SELECT doc_id, origin_db, source, file_path, content, 'state', 0, substring(body, 1, off::BIGINT) FROM q WHERE source = 'worklog:state' AND k = 1 AND off > 0
  UNION ALL SELECT doc_id, origin_db, source, file_path, content, CASE source WHEN 'chat:turns' THEN 'turn' WHEN 'worklog:state' THEN 'state' ELSE 'chunk' END, 0, body FROM b WHERE doc_id NOT IN (SELECT doc_id FROM h)),
 w AS (SELECT *, length(part) AS n, unnest(range(0, (greatest(0, ceil((length(part) - 900) / 675.0)) + 1)::BIGINT)) AS i FROM s WHERE regexp_matches(part, '\S')),
 p AS (SELECT doc_id, origin_db, source, file_path, section, (begin_at + i * 675)::BIGINT AS char_start, (begin_at + least(i * 675 + 900, n))::BIGINT AS char_end, substring(part, (i * 675 + 1)::BIGINT, 900) AS piece,
  concat_ws(' ', 'ticket=' || list_filter(string_split(file_path, '/'), lambda x: regexp_matches(x, '^[a-z]+[0-9]+$'))[1], 'mode=' || nullif(regexp_extract(content, '(?m)^mode: "?([^"\n]*)"?$', 1), ''), 'section=' || section) AS said FROM w),
 z AS (SELECT *, substring(said || chr(10) || piece, 1, 3900) AS passage, substring(sha1(concat_ws('|', coalesce(origin_db, 'null'), coalesce(source, 'null'), coalesce(file_path, 'null'), section, char_start, char_end)), 1, 16) AS passage_id FROM p WHERE regexp_matches(piece, '\S'))"""


@q("rnk_passage_split", f"WITH {_SPLIT} SELECT doc_id, passage_id, section, char_start, char_end, (length(passage) + 3) // 4 AS n_tokens, md5(passage) AS passage_md5 FROM z")
def rnk_passage_split(s, d):
    """Sections of every document, cut into windows, with their heading line, id and size."""
    out = passages.structured_passages(docs(s, d))
    return out.select("doc_id", "passage_id", "section", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "n_tokens", F.md5("passage").alias("passage_md5"))


_WORDS = ("cursor", "gap", "lease", "zone")
_FOLDED = "list_distinct(regexp_extract_all(replace(replace(replace(lower(strip_accents(passage)), 'ł', 'l'), 'đ', 'd'), 'ø', 'o'), '[a-z0-9_]+'))"


@q(
    "rnk_passage_overlap",
    f"""WITH {_SPLIT}, f AS (SELECT doc_id, passage_id, char_start, len(list_intersect({_FOLDED}, {list(_WORDS)})) AS found FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY found DESC, char_start, passage_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n, max(found) OVER (PARTITION BY doc_id) AS top FROM f)
 SELECT doc_id, passage_id, found FROM r WHERE n <= 3 OR (found > 0 AND r <= 3) OR (top = 0 AND r = 1)""",
)
def rnk_passage_overlap(s, d):
    """The passages of every document that are worth scoring for a query."""
    return passages.best_passages(passages.structured_passages(docs(s, d)), list(_WORDS)).select("doc_id", "passage_id", "found")


@q("rnk_rerank_stage")
def rnk_rerank_stage(s, d):
    """Best passage scores of the newest turns, applied in each of the three ways."""
    ranked = RT.placed(fusion.rrf(RT.pool_recency(docs(s, d))), fusion.fused_order(), 50)
    out = None
    for mode in ("rrf", "score", "cut"):
        rows, _ = RT.rerank_stage(docs(s, d), ranked, "cursor gap lease zone", list(_WORDS), SC.OverlapScorer(), RT.Options(rerank=mode), "text")
        rows = rows.select(F.lit(mode).alias("mode"), "pos", "stable_id", F.round("fused_score", 9).alias("fused_score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@q("rnk_cross_encoder", "SELECT doc_id, round(len(list_filter(['cursor', 'lease'], lambda w: list_contains(regexp_extract_all(replace(replace(replace(lower(strip_accents(text)), 'ł', 'l'), 'đ', 'd'), 'ø', 'o'), '[\\p{L}\\p{N}_]+'), w))) / 2.0, 4) AS score FROM documents WHERE text <> ''")
def rnk_cross_encoder(s, d):
    """Pair scores of all texts through the scorer protocol; here the scorer that needs no model."""
    rows = docs(s, d).where(F.col("text") != "")
    return rows.select("doc_id", SC.score_column(SC.OverlapScorer(), "cursor lease", F.col("text")).alias("score"))


@q("rnk_ticket_semantic", f"SELECT doc_id FROM documents WHERE list_contains({sql_tokens('file_path')}, 'turns') AND list_contains({sql_tokens('text')}, 'lease')")
def rnk_ticket_semantic(s, d):
    return text_index(s, d).search("file_path:turns AND content:lease").select("doc_id")


@q("rnk_digest_assemble")
def rnk_digest_assemble(s, d):
    j = journal(s, d).select((F.col("source_fidelity_rank") % 3).alias("tier"), F.col("sequence").alias("position"), "turn_hash", F.octet_length(F.coalesce("assistant_text", F.lit(""))).alias("bytes"))
    return RT.digest(j)


@q("wl_capsule", r"SELECT source_identity, mode AS category, max(sequence) AS sequence FROM journal_observations WHERE mode IN ('plan', 'execute') GROUP BY 1, 2")
def wl_capsule(s, d):
    rows = journal(s, d).select("source_identity", F.col("mode").alias("category"), "sequence")
    return RT.capsule(rows, "source_identity", "category", ["sequence"], ("plan", "execute")).select("source_identity", "category", "sequence")


@q("wl_resume_ticket")
def wl_resume_ticket(s, d):
    """Latest section of each category per worklog ticket."""
    chunks = worklog.parse_worklogs(docs(s, d).where("source = 'worklog:state'").select(F.col("doc_id").cast("string").alias("path"), "text"))
    wanted = ("status", "next-action", "blockers", "decisions", "findings", "actions", "summary")
    return RT.capsule(chunks.where("ticket is not null"), "ticket", "category", ["source_path", "source_order"], wanted).select("ticket", "category", "place", "source_path", "heading")


q("wl_index", r"SELECT nullif(regexp_extract(text, '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b'), '') AS ticket, count(*) AS n FROM documents WHERE source = 'worklog:state' GROUP BY 1")(
    lambda s, d: docs(s, d).where("source = 'worklog:state'").select(F.get(T.tickets(F.col("text")), F.lit(0)).alias("ticket")).groupBy("ticket").agg(F.count(F.lit(1)).alias("n"))
)


@q("ev_systems")
def ev_systems(s, d):
    """What each of the compared systems answers to one question."""
    out = None
    for name, o in sorted(RT.SYSTEMS.items()):
        found = RT.topic_list(docs(s, d), text_index(s, d), "where does the cursor lease stall", o)
        rows = found.rows.where("pos <= 20").select(F.lit(name).alias("system"), "pos", "stable_id", "pool", F.lit(found.form).alias("form"), F.lit(found.degraded).alias("degraded"))
        out = rows if out is None else out.unionByName(rows)
    return out


q("ev_by_class", "SELECT event_type, count(*) AS queries, round(avg(value), 6) AS v FROM events GROUP BY GROUPING SETS ((event_type), ())")(
    lambda s, d: E.mean_metrics(load_table(s, d, "events").withColumn("v", F.col("value")), ["event_type"], ["v"]).select("event_type", "queries", F.round("v", 6).alias("v"))
)


@q("ev_mine_sessions", "SELECT sessionid, count_if(type = 'user') AS asked, count_if(type = 'assistant') AS answered, count(*) FILTER (WHERE contains(message.content, 'tool')) > 0 AS uses_tools FROM (SELECT *, row_number() OVER (PARTITION BY sessionid ORDER BY record_no) AS k FROM claude_turn WHERE sessionid IS NOT NULL) WHERE k <= 15 GROUP BY 1")
def ev_mine_sessions(s, d):
    """The first fifteen records of every session."""
    t = load_table(s, d, "claude_turn").where("sessionid is not null").select("sessionid", "record_no", "type", "message.content")
    head = fusion.top_per_group(t, ["sessionid"], [F.col("record_no")], 15, "k")
    return head.groupBy("sessionid").agg(F.count_if(F.col("type") == "user").alias("asked"), F.count_if(F.col("type") == "assistant").alias("answered"), (F.count_if(F.contains("content", F.lit("tool"))) > 0).alias("uses_tools"))


QUERIES, ORACLE = R.queries, R.oracle
