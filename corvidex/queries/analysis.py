"""Queries of the journal, retrieval, evaluation and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import evaluation as E
from corvidex.operators import fusion
from corvidex.operators import joins as J
from corvidex.operators import journal as JR
from corvidex.operators import retrieval as RT
from corvidex.operators import vectors as V
from corvidex.operators.ordering import blocked_row_number
from corvidex.queries.common import Registry, kept_table, sql_tokens
from corvidex.queries.relational import canonical, docs, journal
from corvidex.session import load_table

R = Registry()
q = R.query

# --- journal ---
_IDEM = """CASE WHEN coalesce(prompt_id, '') <> '' THEN source_identity || '::prompt::' || prompt_id
 WHEN coalesce(session_id, '') <> '' AND (coalesce(source_byte_offset, 0) > 0 OR coalesce(source_start_line, 0) > 0 OR coalesce(source_end_line, 0) > 0) THEN source_identity || '::' || session_id || '::' || coalesce(source_byte_offset, 0) || ':' || coalesce(source_start_line, 0) || ':' || coalesce(source_end_line, 0)
 WHEN coalesce(source_byte_offset, 0) > 0 OR coalesce(source_start_line, 0) > 0 OR coalesce(source_end_line, 0) > 0 THEN source_identity || '::locator::' || coalesce(source_byte_offset, 0) || ':' || coalesce(source_start_line, 0) || ':' || coalesce(source_end_line, 0)
 WHEN coalesce(session_id, '') <> '' THEN source_identity || '::session::' || session_id || '::' || coalesce(recorded_at, '') END"""
q("jrn_idempotency_key", f"SELECT sequence, {_IDEM} AS idempotency_key FROM journal_observations")(lambda s, d: journal(s, d).select("sequence", JR.idempotency_key().alias("idempotency_key")))
q("jrn_content_hash", "SELECT sequence, sha256(coalesce(user_text, '') || chr(10) || coalesce(assistant_text, '')) AS content_sha FROM journal_observations")(
    lambda s, d: journal(s, d).select("sequence", T.content_hash(F.col("user_text"), F.col("assistant_text")).alias("content_sha"))
)
_NORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(%s, ''), '(?im)^\s*(?:user|assistant|human|model)\s*:\s*', '', 'g'), '\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?)?', '', 'g')), '\s+', ' ', 'g'), ' ')"""
q("jrn_turn_hash", f"SELECT sequence, sha256({_NORM % 'user_text'} || chr(10) || {_NORM % 'assistant_text'}) AS turn_sha FROM journal_observations")(
    lambda s, d: journal(s, d).select("sequence", T.turn_hash(F.col("user_text"), F.col("assistant_text")).alias("turn_sha"))
)
q("jrn_normalize", "SELECT sequence, CASE WHEN trim(coalesce(source_identity, ''), ' ') = '' THEN 'no source' WHEN trim(coalesce(user_text, ''), ' ') = '' AND trim(coalesce(assistant_text, ''), ' ') = '' THEN 'no text' END AS problem, coalesce(CASE WHEN trim(coalesce(logical_turn_key, ''), ' ') <> '' THEN logical_turn_key END, CASE WHEN prompt_id <> '' THEN prompt_id WHEN coalesce(source_start_line, 0) > 0 OR coalesce(source_end_line, 0) > 0 THEN source_identity || '#' || coalesce(source_start_line, 0) || '-' || coalesce(source_end_line, 0) END) AS turn_key FROM journal_observations")(
    lambda s, d: JR.normalize_events(journal(s, d)).select("sequence", "problem", F.col("logical_turn_key").alias("turn_key"))
)
q("jrn_record", f"WITH k AS (SELECT sequence, {_IDEM} AS k FROM journal_observations), old AS (SELECT k FROM k WHERE sequence <= 150 AND k IS NOT NULL) SELECT min(sequence) AS sequence FROM k WHERE sequence > 150 AND k IS NOT NULL AND k NOT IN (SELECT k FROM old) GROUP BY k UNION ALL SELECT sequence FROM k WHERE sequence > 150 AND k IS NULL")(
    lambda s, d: _recorded(s, d)
)


def _recorded(s: SparkSession, d: str) -> DataFrame:
    rows = JR.normalize_events(journal(s, d))
    return JR.record_once(rows.where("sequence <= 150"), rows.where("sequence > 150")).select("sequence")


q("jrn_canonical", "SELECT sequence, user_text FROM journal_observations WHERE logical_turn_key IS NULL OR trim(logical_turn_key) = '' UNION ALL SELECT arg_min(sequence, (source_fidelity_rank, -sequence)), arg_min({'u': user_text}, (source_fidelity_rank, -sequence)).u FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY logical_turn_key")(
    lambda s, d: canonical(journal(s, d), ["sequence", "user_text"])
)
q("jrn_verify", "WITH c AS (SELECT sequence, prior_event_hash, lag(event_hash, 1, '') OVER (ORDER BY sequence) AS expected FROM journal_observations) SELECT sequence FROM c WHERE coalesce(expected, '') <> coalesce(prior_event_hash, '')")(
    lambda s, d: JR.verify_chain(journal(s, d), ["sequence", "user_text"]).where("bad_link").select("sequence")
)


@q("jrn_event_hash", "SELECT count(*) AS n, 0::BIGINT AS bad FROM journal_observations")
def jrn_event_hash(s, d):
    """A chain made by our own event hash verifies."""
    rows = journal(s, d).select("sequence", "user_text", F.lit("").alias("prior_event_hash"))
    rows = rows.withColumn("event_hash", JR.event_hash(F.col("prior_event_hash"), ["sequence", "user_text"]))
    bad = JR.verify_chain(rows, ["sequence", "user_text"]).where("bad_hash")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("bad", bad.agg(F.count(F.lit(1))).scalar())


@q("jrn_chain_report", "WITH c AS (SELECT sequence, prior_event_hash, lag(event_hash) OVER (ORDER BY sequence) AS expected, lag(sequence) OVER (ORDER BY sequence) AS prior FROM journal_observations) SELECT count(*) AS n, count_if(sequence - prior > 1) AS gaps, count_if(coalesce(sequence - prior, 1) = 1 AND coalesce(expected, '') <> coalesce(prior_event_hash, '')) AS broken, count(*) AS wrong_hashes, (SELECT count(*) FROM (SELECT logical_turn_key FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)) AS conflicts FROM c")
def jrn_chain_report(s, d):
    """State of the whole journal. Its hashes are opaque here, so none of them is that of our canonical JSON."""
    return JR.chain_report(journal(s, d), ["sequence", "observation_id", "user_text", "assistant_text"])


_RECON = """t AS (SELECT 't' || user_id || '-' || event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'p' || user_id || '-' || (event_id % 40) END AS prompt_id, 's' || user_id AS session_id, md5(event_type) AS content_hash, event_type AS user_text, epoch_us(ts) AS at_us FROM events WHERE event_id % 2 = 0),
 j AS (SELECT 'j' || lpad(event_id::VARCHAR, 9, '0') AS id, CASE WHEN event_id % 5 = 1 THEN 'p' || user_id || '-' || ((event_id - 1) % 40) END AS prompt_id, 's' || user_id AS session_id, md5(event_type || (event_id % 3)) AS content_hash, event_type AS user_text, epoch_us(ts) AS at_us FROM events WHERE event_id % 2 = 1)"""


@q(
    "jrn_reconcile",
    f"""WITH {_RECON}, m AS (SELECT t.id, j.id AS jid, 1 AS rule FROM t JOIN j ON t.prompt_id = j.prompt_id UNION ALL SELECT t.id, j.id, 2 FROM t JOIN j ON t.session_id = j.session_id AND t.content_hash = j.content_hash
 UNION ALL SELECT t.id, j.id, 3 FROM t JOIN j ON t.session_id = j.session_id AND t.user_text = j.user_text AND abs(t.at_us - j.at_us) <= 3600000000), b AS (SELECT id, arg_min(jid, (rule, jid)) AS journal_id, min(rule) AS rule FROM m GROUP BY 1)
 SELECT t.id, b.journal_id, b.rule, CASE WHEN b.id IS NULL THEN 'missing' WHEN j.content_hash = t.content_hash THEN 'exact' WHEN abs(t.at_us - j.at_us) <= 3600000000 THEN 'conflict' ELSE 'lag' END AS kind FROM t LEFT JOIN b USING (id) LEFT JOIN j ON j.id = b.journal_id""",
)
def jrn_reconcile(s, d):
    e = load_table(s, d, "events").withColumns({"session_id": F.concat(F.lit("s"), "user_id"), "at_us": F.unix_micros(F.col("ts").cast("timestamp")), "user_text": F.col("event_type")})
    turns = e.where("event_id % 2 = 0").select(
        F.concat(F.lit("t"), "user_id", F.lit("-"), "event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("p"), "user_id", F.lit("-"), F.col("event_id") % 40)).alias("prompt_id"), "session_id", F.md5("event_type").alias("content_hash"), "user_text", "at_us"
    )
    log = e.where("event_id % 2 = 1").select(
        F.concat(F.lit("j"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("p"), "user_id", F.lit("-"), (F.col("event_id") - 1) % 40)).alias("prompt_id"), "session_id", F.md5(F.concat("event_type", F.col("event_id") % 3)).alias("content_hash"), "user_text", "at_us"
    )
    return J.reconcile(turns, log, 3_600_000_000)


q("join_reconcile", f"WITH {_RECON} SELECT count(*) AS n FROM t JOIN j ON t.session_id = j.session_id AND t.user_text = j.user_text AND abs(t.at_us - j.at_us) <= 3600000000")(lambda s, d: _band(s, d))


def _band(s: SparkSession, d: str) -> DataFrame:
    """The band part alone: equality on session, text and time bucket, then the exact test."""
    w = F.lit(3_600_000_000)
    e = load_table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    b = F.floor(F.col("us") / w)
    left = e.where("event_id % 2 = 0").withColumn("b", F.explode(F.array(b - 1, b, b + 1))).withColumnRenamed("us", "l")
    right = e.where("event_id % 2 = 1").withColumn("b", b).select("user_id", "event_type", "b", F.col("us").alias("r"))
    return left.join(right, ["user_id", "event_type", "b"]).where(F.abs(F.col("l") - F.col("r")) <= 3_600_000_000).agg(F.count(F.lit(1)).alias("n"))


q("jrn_snapshot_ranges", "WITH r AS (SELECT user_id, floor(value)::BIGINT AS a, floor(value + 20)::BIGINT AS b, event_id FROM events), w AS (SELECT *, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r) SELECT user_id, c AS gap_start, a AS gap_end FROM w WHERE a > c")(
    lambda s, d: JR.uncovered_ranges(load_table(s, d, "events").select("user_id", F.floor("value").cast("long").alias("a"), F.floor(F.col("value") + 20).cast("long").alias("b"), "event_id"), "user_id", "a", "b", "event_id")
)
_BODY = "'## User' || chr(10) || chr(10) || coalesce(user_text, '') || chr(10) || chr(10) || '## Assistant' || chr(10) || chr(10) || coalesce(assistant_text, '')"
q("jrn_project", f"WITH c AS (SELECT sequence, {_BODY} AS body FROM journal_observations WHERE sequence > 100 AND coalesce(tier, 'turns') <> 'dross' AND NOT contains(lower({_BODY}), 'ai-vault')) SELECT sequence, 'turns' AS tier, 'turn-' || lpad(sequence::VARCHAR, 6, '0') || '.md' AS file_name FROM c UNION ALL SELECT sequence, 'artifacts', 'artifact-' || lpad(sequence::VARCHAR, 6, '0') || '.md' FROM c WHERE strlen(body) > 700")(
    lambda s, d: JR.project(journal(s, d), 100, 700).select("sequence", "tier", "file_name")
)
q("jrn_rebuild", f"SELECT count(*) AS n, sum(strlen({_BODY}))::BIGINT AS bytes FROM journal_observations WHERE coalesce(tier, 'turns') <> 'dross' AND NOT contains(lower({_BODY}), 'ai-vault')")(
    lambda s, d: JR.project(journal(s, d), 0, 1 << 30).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
)
q("jrn_parity", "SELECT count(*) AS n_surplus FROM (SELECT content_hash, count(*) FILTER (WHERE sequence % 2 = 0) - count(*) FILTER (WHERE sequence % 2 = 1) AS x FROM journal_observations GROUP BY 1) WHERE x <> 0")(
    lambda s, d: J.multiset_difference(journal(s, d).where("sequence % 2 = 0").select("content_hash"), journal(s, d).where("sequence % 2 = 1").select("content_hash")).agg(F.count(F.lit(1)).alias("n_surplus"))
)
q("chat_ticket_extract", r"SELECT sequence, array_to_string(list_filter(regexp_extract_all(coalesce(user_text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b'), lambda x, i: list_position(regexp_extract_all(coalesce(user_text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b'), x) = i), ' ') AS tickets FROM journal_observations")(
    lambda s, d: journal(s, d).select("sequence", F.array_join(T.tickets(F.col("user_text")), " ").alias("tickets"))
)
_LAB = "regexp_matches(coalesce(assistant_text, ''), '(?m)^\\s*(?:#+\\s*)?(?:%s)\\b')"
q("chat_tier", f"SELECT sequence, CASE WHEN {_LAB % 'SEMANTIC COMMIT TITLE|WRITE GATE'} OR ({_LAB % 'FILES CHANGED|REMOTE CHANGES'} AND NOT regexp_matches(coalesce(assistant_text, ''), '(?im)^\\s*(?:#+\\s*)?(?:FILES CHANGED|REMOTE CHANGES)\\s*:?\\s*\\n?\\s*(?:none|no|n/a)\\b')) THEN 'high' WHEN {_LAB % 'FINDINGS?|VERIFICATION|VALIDATION|ROOT CAUSE|RESULT|CONCLUSION|RECOMMENDATION|EXECUTION|DECISION'} THEN 'low' ELSE 'none' END AS impact FROM journal_observations")(
    lambda s, d: journal(s, d).select("sequence", JR.impact("assistant_text").alias("impact"))
)
q("chat_facet_path", r"SELECT sequence, 'turns/' || coalesce(nullif(regexp_replace(lower(regexp_extract(coalesce(user_text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b')), '[^a-z0-9]', '', 'g'), ''), 'noticket') || '/' || coalesce(nullif(trim(mode), ''), 'nomode') || '/impact-' || coalesce(impact, 'none') || '/turn-' || lpad(sequence::VARCHAR, 6, '0') || '.md' AS path FROM journal_observations")(
    lambda s, d: journal(s, d).select(
        "sequence",
        F.concat(F.lit("turns/"), F.coalesce(T.ticket_facet(F.get(T.tickets(F.col("user_text")), F.lit(0))), F.lit("noticket")), F.lit("/"), F.coalesce(F.when(F.trim("mode") != "", F.trim("mode")), F.lit("nomode")), F.lit("/impact-"), F.coalesce("impact", F.lit("none")), F.format_string("/turn-%06d.md", "sequence")).alias("path"),
    )
)
q("win_turn_assembly", "WITH t AS (SELECT sessionid, record_no, message.role AS role, message.content AS content FROM claude_turn WHERE type IN ('user', 'assistant') AND sessionid IS NOT NULL), g AS (SELECT *, count_if(lower(role) = 'user') OVER (PARTITION BY sessionid ORDER BY record_no ROWS UNBOUNDED PRECEDING) AS turn FROM t) SELECT sessionid, turn, count(*) - 1 AS replies, md5(string_agg(coalesce(content, ''), chr(10) ORDER BY record_no)) AS body FROM g WHERE turn > 0 GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda s, d: _turns(s, d)
)


def _turns(s: SparkSession, d: str) -> DataFrame:
    """A user record starts a turn; the following records belong to it; unanswered turns are held back."""
    t = load_table(s, d, "claude_turn").where("type in ('user', 'assistant') and sessionid is not null").select("sessionid", "record_no", "message.role", "message.content")
    w = Window.partitionBy("sessionid").orderBy("record_no").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("turn", F.sum(F.when(F.lower("role") == "user", 1).otherwise(0)).over(w)).where("turn > 0")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("record_no", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"])
    return t.groupBy("sessionid", "turn").agg((F.count(F.lit(1)) - 1).alias("replies"), F.md5(F.array_join(lines, "\n")).alias("body")).where("replies > 0")


# --- retrieval ---
_SEQ = "SELECT source_identity AS k, sequence AS seq FROM journal_observations"
q("rnk_neighbors", f"WITH r AS ({_SEQ}), a AS (SELECT *, row_number() OVER (ORDER BY seq) AS p FROM r WHERE seq % 89 = 0) SELECT r.k, r.seq, min(p) AS anchor_pos FROM r JOIN a ON r.k = a.k AND r.seq > a.seq AND r.seq <= a.seq + 3 WHERE r.seq % 89 <> 0 GROUP BY 1, 2")(
    lambda s, d: _after(s, d)
)


def _after(s: SparkSession, d: str) -> DataFrame:
    rows = journal(s, d).select(F.col("source_identity").alias("k"), F.col("sequence").alias("seq"))
    anchors = blocked_row_number(rows.where("seq % 89 = 0"), [], [F.col("seq")], "anchor_pos")
    return fusion.neighbours(anchors, rows, "k", "seq", 3, "after").select("k", "seq", F.col("anchor_pos").cast("long").alias("anchor_pos"))


@q(
    "rnk_pack",
    """WITH RECURSIVE i AS (SELECT source, doc_id, strlen(coalesce(content, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
 p AS (SELECT source, doc_id, k, CASE WHEN n <= 3000 THEN n ELSE 0 END AS used, n <= 3000 AS kept FROM i WHERE k = 1
 UNION ALL SELECT i.source, i.doc_id, i.k, CASE WHEN p.used + i.n <= 3000 THEN p.used + i.n ELSE p.used END, p.used + i.n <= 3000 FROM p JOIN i ON i.source = p.source AND i.k = p.k + 1) SELECT source, doc_id FROM p WHERE kept""",
)
def rnk_pack(s, d):
    """Greedy packing that skips what does not fit."""
    items = docs(s, d).where("source is not null").select("source", "doc_id", F.octet_length(F.coalesce("content", F.lit(""))).alias("n"))
    return fusion.pack_budget(items, ["source"], [F.col("doc_id")], "n", 3000).select("source", "doc_id")


q("rnk_overlap_stub", f"SELECT doc_id, round(len(list_filter(['archive', 'cursor', 'queue'], lambda w: list_contains({sql_tokens('text')}, w))) / 3.0, 4) AS score FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", fusion.overlap_score(T.tokens(F.col("text")), ["cursor", "queue", "archive"]).alias("score"))
)


@q(
    "rnk_passage_bm25",
    f"""WITH x AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE source = 'worklog:state' AND length(text) > 0), p AS (SELECT doc_id, text, unnest(range(0, (greatest(0, ceil((n - 900) / 675.0)) + 1)::BIGINT)) AS i FROM x),
 t AS (SELECT doc_id, i AS passage_no, {sql_tokens('substring(text, i * 675 + 1, 900)')} AS tk FROM p), c AS (SELECT doc_id, passage_no, len(tk) AS n, len(list_filter(tk, lambda w: w = 'lease')) AS f FROM t),
 s AS (SELECT doc_id, count(*) AS nd, avg(n) AS av, count_if(f > 0) AS nf FROM c GROUP BY 1)
 SELECT doc_id, passage_no, round(ln(1 + (nd - nf + 0.5) / (nf + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score FROM c JOIN s USING (doc_id) WHERE f > 0""",
)
def rnk_passage_bm25(s, d):
    """BM25 of passages within their own document."""
    p = fusion.passages(docs(s, d).where("source = 'worklog:state'").select("doc_id", "text"), ["doc_id"], "text")
    tk = T.tokens(F.col("passage"))
    c = p.select("doc_id", F.col("passage_no").cast("long").alias("passage_no"), F.size(tk).alias("n"), F.size(F.filter(tk, lambda w: w == "lease")).alias("f"))
    st = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nd"), F.avg("n").alias("av"), F.count_if(F.col("f") > 0).alias("nf"))
    idf = F.ln(1 + (F.col("nd") - F.col("nf") + 0.5) / (F.col("nf") + 0.5))
    score = idf * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("av")))
    return c.where("f > 0").join(st, "doc_id").select("doc_id", "passage_no", F.round(score, 6).alias("score"))


q("rnk_topic_route", "WITH t AS (SELECT lower(coalesce(text, '')) AS t FROM documents WHERE source = 'chat:turns' ORDER BY doc_id LIMIT 10) SELECT (max(contains(t, 'cursor')::INT) + max(contains(t, 'quagga')::INT) + max(contains(t, 'archive')::INT)) / 3.0 AS covered FROM t")(
    lambda s, d: E.covered_share(docs(s, d).where("source = 'chat:turns'").orderBy("doc_id").limit(10), ["cursor", "quagga", "archive"], "text")
)
@q("rnk_coverage")
def rnk_coverage(s, d):
    """The turns of every ticket that together cover most, by the frequencies of all turns; tested against a plain loop."""
    turns = docs(s, d).where("source = 'chat:turns'")
    own = RT.turn_columns(turns).where("ticket <> ''")
    newest = fusion.top_per_group(own.select("ticket", "doc_id", F.coalesce("sequence", F.lit(0)).alias("sequence"), "text"), ["ticket"], [F.col("sequence").desc(), F.col("doc_id").desc()], 5000)
    cand = newest.select("ticket", F.col("doc_id").alias("id"), "sequence", RT.coverage_tokens(F.col("text")).alias("tokens"))
    freq = kept_table(s, d, "documents", "token-df", RT.token_frequencies)
    return E.greedy_coverage(cand, ["ticket"], freq, max(1, turns.count()), 5)


# --- evaluation ---
_EVAL = """lab AS (SELECT event_type AS qid, 'u' || (user_id % 40) AS doc, (sum(event_id) % 4)::INT AS grade FROM events GROUP BY ALL),
 rk AS (SELECT event_type AS qid, 'u' || (user_id % 60) AS doc, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 120),
 h AS (SELECT rk.*, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY rk.qid, rk.doc ORDER BY rank) AS nth FROM rk LEFT JOIN lab USING (qid, doc)),
 o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM h WHERE nth = 1),
 w AS (SELECT qid, count_if(grade >= 2) AS n FROM lab GROUP BY 1),
 id AS (SELECT qid, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS place FROM lab WHERE grade > 0) WHERE place <= 10 GROUP BY 1),
 m AS (SELECT w.qid, (SELECT count_if(grade >= 2 AND rank <= 10) FROM o WHERE o.qid = w.qid) / n AS recall_10, (SELECT count_if(grade >= 2 AND rank <= 50) FROM o WHERE o.qid = w.qid) / n AS recall_50,
  (SELECT sum((pow(2, grade) - 1) / log2(place + 1)) FROM o WHERE o.qid = w.qid AND rank <= 10) / ideal AS ndcg_10, coalesce(1.0 / (SELECT min(rank) FROM h WHERE h.qid = w.qid AND grade >= 2 AND rank <= 10), 0) AS mrr_10,
  (SELECT max((grade >= 2 AND rank <= 1)::INT) FROM h WHERE h.qid = w.qid)::DOUBLE AS success_1 FROM w JOIN id USING (qid))"""


def _metrics(s: SparkSession, d: str) -> DataFrame:
    e = load_table(s, d, "events")
    labels = e.groupBy(F.col("event_type").alias("qid"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("doc")).agg((F.sum("event_id") % 4).cast("int").alias("grade"))
    ranked = fusion.top_per_group(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 120).select(F.col("event_type").alias("qid"), F.concat(F.lit("u"), F.col("user_id") % 60).alias("doc"), "rank")
    return E.query_metrics(ranked, labels)


for _name, _col in (("ev_recall", "recall_10"), ("ev_ndcg", "ndcg_10"), ("ev_rr", "mrr_10"), ("ev_success", "success_1")):
    q(_name, f"WITH {_EVAL} SELECT qid, round({_col}, 6) AS {_col} FROM m")(lambda s, d, c=_col: _metrics(s, d).select("qid", F.round(c, 6).alias(c)))
q("ev_aggregate", f"WITH {_EVAL} SELECT count(*) AS queries, round(avg(recall_50), 6) AS recall_50, round(avg(ndcg_10), 6) AS ndcg_10 FROM m")(
    lambda s, d: E.mean_metrics(_metrics(s, d), [], ["recall_50", "ndcg_10"]).select("queries", F.round("recall_50", 6).alias("recall_50"), F.round("ndcg_10", 6).alias("ndcg_10"))
)
q("ev_zero", f"WITH {_EVAL} SELECT DISTINCT qid, (qid NOT IN (SELECT qid FROM rk))::DOUBLE AS zero_result FROM lab")(lambda s, d: _metrics(s, d).select("qid", "zero_result"))
_LANG = "CASE WHEN qid < 'd' THEN 'en' ELSE 'pl' END"
q("ev_by_language", f"WITH {_EVAL} SELECT {_LANG} AS lang, count(*) AS queries, round(avg(recall_50), 6) AS recall_50, round(avg(ndcg_10), 6) AS ndcg_10 FROM m GROUP BY GROUPING SETS (({_LANG}), ())")(
    lambda s, d: E.mean_metrics(_metrics(s, d).withColumn("lang", F.when(F.col("qid") < "d", "en").otherwise("pl")), ["lang"], ["recall_50", "ndcg_10"]).select("lang", "queries", F.round("recall_50", 6).alias("recall_50"), F.round("ndcg_10", 6).alias("ndcg_10"))
)
q("join_labels", f"WITH {_EVAL} SELECT qid, doc, rank, grade FROM h WHERE rank <= 20")(lambda s, d: _labelled(s, d))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    e = load_table(s, d, "events")
    labels = e.groupBy(F.col("event_type").alias("qid"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("doc")).agg((F.sum("event_id") % 4).cast("int").alias("grade"))
    ranked = fusion.top_per_group(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 20).select(F.col("event_type").alias("qid"), F.concat(F.lit("u"), F.col("user_id") % 60).alias("doc"), F.col("rank").cast("long").alias("rank"))
    return ranked.join(labels, ["qid", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


q("ev_paired_report", "WITH v AS (SELECT event_type AS grp, user_id AS qid, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1, 2) SELECT grp, count(*) AS pairs, round(avg(b - a), 6) AS mean_diff, count_if(b > a) AS wins, count_if(b < a) AS losses, round(min(b - a), 6) AS worst FROM v WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")(
    lambda s, d: E.paired_report(load_table(s, d, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("qid"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("system")).agg(F.avg("value").alias("value")), "a", "b", ["grp"]).select("grp", "pairs", F.round("mean_diff", 6).alias("mean_diff"), "wins", "losses", F.round("worst", 6).alias("worst"))
)


def _differences(s: SparkSession, d: str) -> DataFrame:
    v = load_table(s, d, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("qid"))
    return v.agg((F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))) - F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")))).alias("difference"))


@q("ev_bootstrap")
def ev_bootstrap(s, d):
    """Intervals with the generator of ``java.util.Random``; tested against known draws."""
    return E.bootstrap(_differences(s, d), ["grp"], E.bootstrap_java)


@q("ev_bootstrap_py")
def ev_bootstrap_py(s, d):
    return E.bootstrap(_differences(s, d), ["grp"], E.bootstrap_python, seed=1)


_FACTS = "f AS (SELECT source AS task, label::VARCHAR AS fact, min(rank) AS rank, 1.0 + label / 10.0 AS weight FROM (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents JOIN embeddings ON vec_id = doc_id) GROUP BY source, label)"


def _facts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = docs(s, d).select("source", "doc_id").join(load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    r = blocked_row_number(rows, ["source"], [F.col("doc_id")], "rank")
    present = r.select(F.col("source").alias("task"), F.col("label").cast("string").alias("fact"), "rank")
    return present, r.select(F.col("source").alias("task"), F.col("label").cast("string").alias("fact"), (1.0 + F.col("label") / 10.0).alias("weight")).distinct()


q("ev_fact_recall", f"WITH {_FACTS} SELECT task, round(sum(CASE WHEN rank <= 10 THEN weight ELSE 0 END) / sum(weight), 6) AS fact_recall_10, round(sum(CASE WHEN rank <= 30 THEN weight ELSE 0 END) / sum(weight), 6) AS fact_recall_30 FROM f GROUP BY 1")(
    lambda s, d: E.fact_recall(*_facts(s, d)).select("task", F.round("fact_recall_10", 6).alias("fact_recall_10"), F.round("fact_recall_30", 6).alias("fact_recall_30"))
)
q("ev_coverage", f"WITH {_FACTS} SELECT task, round(sum(CASE WHEN rank <= 50 THEN weight ELSE 0 END) / sum(weight), 6) AS coverage FROM f GROUP BY 1")(lambda s, d: E.fact_recall(*_facts(s, d), cuts=(50,)).select("task", F.round("fact_recall_50", 6).alias("coverage")))
q("ev_fact_dcg", f"WITH {_FACTS} SELECT task, round(sum(weight / log2(rank + 1)), 6) AS dcg FROM f WHERE rank <= 10 GROUP BY 1")(lambda s, d: E.fact_dcg(*_facts(s, d)).select("task", F.round("dcg", 6).alias("dcg")))
# every text here holds one fact, so the best order is by weight
q("ev_ndcg_coverage", f"WITH {_FACTS}, i AS (SELECT task, weight, row_number() OVER (PARTITION BY task ORDER BY weight DESC) AS place FROM f), g AS (SELECT task, sum(weight / log2(place + 1)) AS ideal FROM i WHERE place <= 10 GROUP BY 1), a AS (SELECT task, sum(weight / log2(rank + 1)) AS dcg FROM f WHERE rank <= 10 GROUP BY 1) SELECT task, round(dcg, 6) AS dcg, round(ideal, 6) AS ideal, round(dcg / ideal, 6) AS ndcg FROM a JOIN g USING (task)")(
    lambda s, d: E.ndcg_coverage(*_facts(s, d)).select("task", *[F.round(c, 6).alias(c) for c in ("dcg", "ideal", "ndcg")])
)
_HITS = "r AS (SELECT source AS task, label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents JOIN embeddings ON vec_id = doc_id)"
q("ev_precision_proxy", f"WITH {_HITS} SELECT task, round(count_if(rank <= 10 AND label < 3) / least(10, max(rank)), 6) AS precision_10 FROM r GROUP BY 1")(lambda s, d: _precision(s, d))


def _precision(s: SparkSession, d: str) -> DataFrame:
    """Texts that hold one of the first three facts."""
    present, _ = _facts(s, d)
    return E.precision_proxy(present.where(F.col("fact").cast("int") < 3), present).select("task", F.round("precision_10", 6).alias("precision_10"))


q("ev_pool", "WITH r AS ((SELECT doc_id, 'chars' AS system, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS pos FROM documents QUALIFY pos <= 50) UNION ALL (SELECT doc_id, 'bytes', row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, doc_id) AS pos FROM documents QUALIFY pos <= 50)) SELECT doc_id, string_agg(system, ',' ORDER BY system) AS systems, min(pos) AS best FROM r GROUP BY 1")(lambda s, d: _pooled(s, d))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    """The first fifty documents of two orders, pooled for labelling."""
    lists = None
    for system, column in (("chars", "n_chars"), ("bytes", "size_bytes")):
        order = [F.col(column).desc_nulls_last(), F.col("doc_id")]
        top = docs(s, d).orderBy(*order).limit(50).select(F.lit(system).alias("system"), "doc_id", F.row_number().over(Window.orderBy(*order)).alias("pos"))
        lists = top if lists is None else lists.unionByName(top)
    return E.pool(lists, "doc_id").select("doc_id", F.array_join("systems", ",").alias("systems"), F.col("best").cast("long").alias("best"))


@q("ev_false_match")
def ev_false_match(s, d):
    """Rate of an anchor in a hashed sample of other texts."""
    sample = E.hash_sample(docs(s, d).where("text is not null").select("doc_id", "text"), "doc_id", 300, "false-match")
    return sample.agg(F.avg(F.col("text").rlike("cursor").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


@q("ev_fingerprint")
def ev_fingerprint(s, d):
    return E.fingerprint(docs(s, d), ["origin_db"], "doc_id", "text")


# --- vectors ---
q("vec_quantize", "WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127.0 AS scale FROM embeddings) SELECT vec_id, round(scale, 9) AS scale, md5(array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE / scale, 0)::INT), ',')) AS codes_md5 FROM s")(
    lambda s, d: load_table(s, d, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q")).select("vec_id", F.round("q.scale", 9).alias("scale"), F.md5(F.array_join(F.col("q.codes").cast("array<string>"), ",")).alias("codes_md5"))
)
q("vec_dequantize", "SELECT vec_id, true AS close FROM embeddings")(
    lambda s, d: load_table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("e"), V.quantize(F.col("embedding")).alias("q")).select("vec_id", F.forall(F.zip_with("e", V.dequantize(F.col("q")), lambda a, b: F.abs(a - b)), lambda x: x <= F.col("q.scale") * 0.5001).alias("close"))
)
_QV = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


@q("vec_search", f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {_QV}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 25")
def vec_search(s, d):
    e = load_table(s, d, "embeddings")
    query = [list(e.orderBy("vec_id").first().embedding)]
    return V.search(e.where("label <> 3"), query, "vec_id", "embedding", 25)


@q("vec_maxsim", "WITH qv AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 2), p AS (SELECT e.vec_id // 10 AS passage, qv.vec_id, max(list_sum(list_transform(list_zip(e.embedding, qv.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS best FROM embeddings e, qv GROUP BY 1, 2) SELECT passage, round(sum(best), 4) AS score FROM p GROUP BY 1 ORDER BY score DESC, passage LIMIT 1000")
def vec_maxsim(s, d):
    e = load_table(s, d, "embeddings")
    query = [list(r.embedding) for r in e.orderBy("vec_id").limit(2).collect()]
    passages = e.groupBy(F.floor(F.col("vec_id") / 10).alias("passage")).agg(F.collect_list("embedding").alias("vs"))  # ten vectors each
    return V.search(passages, query, "passage", "vs", 1000, multi=True)


q("vec_encode_stub", f"SELECT doc_id, len({sql_tokens('file_name')}) AS n_vectors FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.size(V.encode_words(T.tokens(F.col("file_name")))).cast("long").alias("n_vectors"))
)
q("vec_index_batch", "SELECT doc_id FROM documents WHERE source = 'chat:turns' AND doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 32")(
    lambda s, d: V.missing(docs(s, d).where("source = 'chat:turns'").select("doc_id", F.lit(1).alias("v")), load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "v").select("doc_id").orderBy("doc_id").limit(32)
)
q("vec_index_version", "SELECT count(*) AS n, max(vec_id) AS newest, count(*) || ':' || max(vec_id) AS stamp FROM embeddings")(
    lambda s, d: load_table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("newest"), F.concat_ws(":", F.count(F.lit(1)), F.max("vec_id")).alias("stamp"))
)
q("vec_index_status", "SELECT count(doc_id) AS passages, count(vec_id) AS vectors, count_if(vec_id IS NULL) AS unindexed, count_if(doc_id IS NULL) AS stale, count_if(vec_id IS NULL) = 0 AS complete FROM documents FULL JOIN embeddings ON vec_id = doc_id")(
    lambda s, d: V.index_status(docs(s, d).select("doc_id"), load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
)


@q("agg_star_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_star_pricing(s, d):
    line = load_table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n")
    )


@q("top_orders", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(s, d):
    top = load_table(s, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")
    return load_table(s, d, "customer").join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_totalprice")


QUERIES, ORACLE = R.queries, R.oracle
