"""Filters, joins, aggregates, windows, sorts and set operations on the documents and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import aggregates as A
from corvidex.operators import evidence as EV
from corvidex.operators import filters as FL
from corvidex.operators import fusion
from corvidex.operators import joins as J
from corvidex.operators.ordering import blocked_row_number, blocked_running_max
from corvidex.operators.retrieval import coverage_tokens, splice
from corvidex.queries.common import Registry
from corvidex.session import load_table

R = Registry()
q = R.query


def docs(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "documents")


def journal(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "journal_observations")


def manifest(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "ingestion_manifest")


# --- filters ---
q("flt_path_like", "SELECT doc_id, file_path FROM documents WHERE file_path ILIKE '%ledger%' ORDER BY file_path, doc_id LIMIT 200")(
    lambda s, d: FL.path_like(docs(s, d), "ledger", 200).select("doc_id", "file_path")
)
q("flt_extension_eq", "SELECT doc_id FROM documents WHERE coalesce(extension, '') = '.sql'")(lambda s, d: FL.extension_eq(docs(s, d), "SQL").select("doc_id"))
q("flt_extension_in", "SELECT doc_id, extension FROM documents WHERE lower(coalesce(extension, '')) IN ('.java', '.py', '')")(
    lambda s, d: FL.extension_in(docs(s, d), ["java", ".PY", "none", "java"]).select("doc_id", "extension")
)
q("flt_archive", "SELECT doc_id, source FROM documents WHERE source = 'chat' OR source ILIKE '%chat%'")(lambda s, d: FL.archive(docs(s, d), "chat").select("doc_id", "source"))
_FACETS = r"regexp_extract(file_path, '^turns/([^/]*)/d(\d{8})/([^/]*)/impact-([^/]*)/turn-0*(\d+)\.md$', %d)"
q("flt_facets", f"SELECT doc_id, {_FACETS % 1} AS ticket FROM documents WHERE {_FACETS % 3} = 'execute' AND {_FACETS % 2} BETWEEN '20250101' AND '20251231'")(
    lambda s, d: FL.facet(docs(s, d), mode="execute", since="20250101", until="20251231").select("doc_id", FL.facet_columns()["ticket"].alias("ticket"))
)
q("flt_month_facets", "SELECT doc_id FROM documents WHERE regexp_matches(file_path, '/d2025(03|04|05)')")(
    lambda s, d: docs(s, d).where(F.col("file_path").rlike("/(" + "|".join(_months()) + ")")).select("doc_id")
)


def _months() -> list[str]:
    import datetime as dt

    from corvidex.plans.planner import month_prefixes

    return month_prefixes(dt.date(2025, 3, 4), dt.date(2025, 5, 2))


q("flt_recent_turns", r"SELECT doc_id, regexp_extract(file_name, '^turn-0*(\d+)', 1)::BIGINT AS sequence FROM documents WHERE regexp_matches(file_name, '^turn-[0-9].*\.md$') ORDER BY sequence DESC, origin_db, file_path, doc_id DESC LIMIT 50")(
    lambda s, d: FL.recent_turns(docs(s, d), 50).select("doc_id", "sequence")
)
q("top_recent", r"SELECT doc_id, file_name FROM documents WHERE regexp_matches(file_name, '^turn-[0-9].*\.md$') ORDER BY regexp_extract(file_name, '^turn-0*(\d+)', 1)::BIGINT DESC, origin_db, file_path, doc_id DESC LIMIT 12")(
    lambda s, d: FL.recent_turns(docs(s, d), 12).select("doc_id", "file_name")
)
q("flt_scope", "SELECT origin_db, count(*) AS n FROM documents WHERE origin_db IN ('convo.db', 'worklogs.db') GROUP BY 1")(
    lambda s, d: FL.scope(docs(s, d), None, docs(s, d).where("source in ('chat:turns', 'worklog:state')").select("origin_db")).groupBy("origin_db").agg(F.count(F.lit(1)).alias("n"))
)
_NOISE = "contains(lower(coalesce(content, '')), 'ai-vault') AND (" + " OR ".join(f"contains(lower(coalesce(content, '')), '{m}')" for m in T.HANDOFF_MARKERS) + ")"
q("flt_excluded", f"SELECT doc_id, {_NOISE} AS excluded FROM documents")(lambda s, d: docs(s, d).select("doc_id", T.is_handoff_noise(F.col("content")).alias("excluded")))
_USER_PART = r"CASE WHEN contains(coalesce(text, ''), '## User') THEN regexp_extract(text, '(?s)## User\s*(.*?)(?:\n## Assistant|\z)', 1) ELSE %s END"
q("flt_retrieval_meta", f"""SELECT doc_id FROM documents WHERE regexp_matches({_USER_PART % "coalesce(text, '')"}, '{EV.RETRIEVAL_META}')""")(
    lambda s, d: docs(s, d).where(EV.is_retrieval_meta(F.col("text"))).select("doc_id")
)
_KEY = r"nullif(regexp_extract(coalesce(text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b'), '')"
q("flt_explicit_ticket", f"""WITH t AS (SELECT doc_id, {_KEY} AS ticket, upper({_USER_PART % "''"}) AS said FROM documents) SELECT doc_id, ticket FROM t WHERE contains(said, ticket) OR contains(said, replace(ticket, '-', ''))""")(
    lambda s, d: docs(s, d).withColumn("ticket", F.get(T.tickets(F.col("text")), F.lit(0))).where(EV.names_ticket(F.col("text"), F.col("ticket"))).select("doc_id", "ticket")
)
# SQL's word boundary knows ASCII letters only, so it is spelled out
_MATERIAL_SQL = EV.MATERIAL.replace(r"(?is)\b", r"(?is)(?:^|[^\p{L}\p{N}\p{M}_])").removesuffix(r"\b") + r"(?:$|[^\p{L}\p{N}\p{M}_])"
q("flt_material_evidence", f"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '{_MATERIAL_SQL}')")(lambda s, d: docs(s, d).where(EV.is_material(F.col("text"))).select("doc_id"))
# fixed values: user texts that carry nothing by themselves
DROSS = ("", "pushed", "what now?", "check now", "go next", "yes", "ok", "mode: research", "mode: innovate", "mode: plan", "mode: execute")
q("flt_dross", f"SELECT sequence FROM journal_observations WHERE lower(trim(coalesce(user_text, ''))) IN {DROSS} AND strlen(coalesce(assistant_text, '')) < 120 AND NOT regexp_matches(coalesce(assistant_text, ''), '(FILES|REMOTE) CHANGE')")(
    lambda s, d: journal(s, d)
    .where(F.lower(F.trim(F.coalesce("user_text", F.lit("")))).isin(*DROSS) & (F.octet_length(F.coalesce("assistant_text", F.lit(""))) < 120))
    .where(~F.coalesce("assistant_text", F.lit("")).rlike("(FILES|REMOTE) CHANGE"))
    .select("sequence")
)
q("flt_literal", "SELECT sequence FROM journal_observations WHERE user_text ILIKE '%100$%%' ESCAPE '$' OR user_text ILIKE '%zonetable%' OR assistant_text ILIKE '%zonetable%' OR outcome_summary ILIKE '%zonetable%' OR logical_turn_key ILIKE '%zonetable%' ORDER BY sequence LIMIT 100")(
    lambda s, d: FL.literal(journal(s, d), ["user_text", "assistant_text", "outcome_summary", "logical_turn_key"], "ZoneTable", "sequence", 100).select("sequence")
)
q("flt_regex", r"SELECT sequence FROM journal_observations WHERE regexp_matches(concat_ws(chr(10), user_text, assistant_text, outcome_summary, mode), 'ledger\s+projector.*\d{3}') ORDER BY sequence LIMIT 100")(
    lambda s, d: FL.regex(journal(s, d), ["user_text", "assistant_text", "outcome_summary", "mode"], r"ledger\s+projector.*\d{3}", "sequence", 100).select("sequence")
)
q("flt_sequence_range", "SELECT sequence, observation_id FROM journal_observations WHERE sequence BETWEEN 50 AND 90")(lambda s, d: FL.sequence_range(journal(s, d), 90, 50).select("sequence", "observation_id"))
q("flt_tail", "SELECT sequence FROM journal_observations ORDER BY sequence DESC LIMIT 25")(lambda s, d: FL.tail(journal(s, d), 25).select("sequence"))
q("flt_after_sequence", "SELECT sequence FROM journal_observations WHERE sequence > 300")(lambda s, d: FL.after_sequence(journal(s, d), 300).select("sequence"))
q("flt_by_prompt", "SELECT sequence, prompt_id FROM journal_observations WHERE prompt_id = (SELECT min(prompt_id) FROM journal_observations)")(
    lambda s, d: FL.by_key(journal(s, d), "prompt_id", journal(s, d).agg(F.min("prompt_id")).first()[0]).select("sequence", "prompt_id")
)
q("flt_by_session", "SELECT sequence, session_id FROM journal_observations WHERE session_id = (SELECT max(session_id) FROM journal_observations) ORDER BY sequence")(
    lambda s, d: FL.by_key(journal(s, d), "session_id", journal(s, d).agg(F.max("session_id")).first()[0]).orderBy("sequence").select("sequence", "session_id")
)
q("flt_by_source", "SELECT sequence FROM journal_observations WHERE source_identity = (SELECT min(source_identity) FROM journal_source_identities)")(
    lambda s, d: journal(s, d).join(F.broadcast(load_table(s, d, "journal_source_identities").agg(F.min("source_identity").alias("source_identity"))), "source_identity", "left_semi").select("sequence")
)
q("flt_as_of", "SELECT count(*) AS n, max(sequence) AS last FROM journal_observations WHERE sequence <= 200")(
    lambda s, d: journal(s, d).where("sequence <= 200").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last"))
)
q("flt_frozen_corpus", "SELECT count(*) AS all_docs, count_if(indexed_at > TIMESTAMPTZ '2026-01-01 00:00:00+00') AS too_new, count_if(doc_id > 500) AS above_cut, count_if(coalesce(indexed_at <= TIMESTAMPTZ '2026-01-01 00:00:00+00', true) AND doc_id <= 500) AS kept FROM documents")(
    lambda s, d: docs(s, d).agg(
        F.count(F.lit(1)).alias("all_docs"),
        F.count_if(F.col("indexed_at") > F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("too_new"),
        F.count_if(F.col("doc_id") > 500).alias("above_cut"),
        F.count_if(F.coalesce(F.col("indexed_at") <= F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit(True)) & (F.col("doc_id") <= 500)).alias("kept"),
    )
)
q("src_documents", "SELECT doc_id, origin_db, source, file_path, is_compressed FROM documents")(lambda s, d: docs(s, d).select("doc_id", "origin_db", "source", "file_path", "is_compressed"))
q("src_doc_by_id", "SELECT doc_id, file_name, n_chars FROM documents WHERE doc_id = 42")(lambda s, d: docs(s, d).where("doc_id = 42").select("doc_id", "file_name", "n_chars"))
q("src_doc_by_path", "SELECT min(doc_id) AS doc_id FROM documents WHERE source = 'chat:turns' AND file_path = (SELECT min(file_path) FROM documents WHERE source = 'chat:turns')")(
    lambda s, d: docs(s, d).where("source = 'chat:turns'").agg(F.min_by("doc_id", F.struct("file_path", "doc_id")).alias("doc_id"))
)
q("src_db_discovery", "SELECT DISTINCT origin_db FROM documents WHERE NOT regexp_matches(origin_db, '(-wal|-shm|journal)')")(
    lambda s, d: docs(s, d).where(~F.col("origin_db").rlike("(-wal|-shm|journal)")).select("origin_db").distinct()
)
q("prj_doc_columns", "SELECT doc_id, origin_db, source, file_path, file_name, extension, size_bytes FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", "origin_db", "source", "file_path", "file_name", "extension", "size_bytes")
)
_FM = r"regexp_extract(content, '(?m)^%s: \"?([^\"\n]*)\"?$', 1)"
q("prj_enrich_turn", f"SELECT doc_id, nullif({_FM % 'source'}, '') AS fm_source, nullif({_FM % 'mode'}, '') AS fm_mode, nullif({_FM % 'impact'}, '') AS fm_impact FROM documents WHERE content LIKE '---%'")(
    lambda s, d: docs(s, d).where(F.startswith("content", F.lit("---"))).select("doc_id", T.front_matter_map(F.col("content")).alias("m")).select("doc_id", *[F.col("m")[k].alias(f"fm_{k}") for k in ("source", "mode", "impact")])
)

# --- joins ---
_MAN = "SELECT m.source_archive, m.ingested_documents, count(d.doc_id) AS live, coalesce(sum(d.size_bytes), 0)::BIGINT AS live_bytes FROM ingestion_manifest m LEFT JOIN documents d ON d.source = m.source_archive GROUP BY ALL"


@q("join_manifest_docs", _MAN)
def join_manifest_docs(s, d):
    live = docs(s, d).groupBy("source").agg(F.count("doc_id").alias("live"), F.sum("size_bytes").alias("live_bytes"))
    out = manifest(s, d).join(live, F.col("source_archive") == F.col("source"), "left")
    return out.select("source_archive", "ingested_documents", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("live_bytes", F.lit(0)).alias("live_bytes"))


q("join_missing_docs", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.is_compressed = 1 AND o.source = d.source AND o.doc_id = d.doc_id)")(
    lambda s, d: docs(s, d).join(docs(s, d).where("is_compressed = 1").select("source", "doc_id"), ["source", "doc_id"], "left_anti").select("doc_id")
)
q("join_orphans", "SELECT DISTINCT source_archive FROM ingestion_manifest WHERE source_archive NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")(
    lambda s, d: manifest(s, d).join(docs(s, d).select(F.col("source").alias("source_archive")), "source_archive", "left_anti").select("source_archive").distinct()
)
q("join_missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")(
    lambda s, d: docs(s, d).join(load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
)
q("join_vectors_passages", "SELECT d.doc_id, e.label FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source = 'chat:turns'")(
    lambda s, d: load_table(s, d, "embeddings").join(docs(s, d).where("source = 'chat:turns'").select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("doc_id"), "label")
)
q("join_cache_lookup", "SELECT d.doc_id, e.label AS cached FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")(
    lambda s, d: docs(s, d).select("doc_id").join(load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cached")), "doc_id", "left")
)


@q("join_hydrate", "WITH t AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) SELECT doc_id, md5(text) AS text_md5 FROM documents JOIN t USING (doc_id)")
def join_hydrate(s, d):
    """Content is fetched only for the survivors of a top-k over narrow columns."""
    top = docs(s, d).orderBy(F.col("n_chars").desc_nulls_last(), "doc_id").limit(20).select("doc_id")
    return docs(s, d).join(F.broadcast(top), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@q("join_late_hits", "SELECT source, min(doc_id) AS doc_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE label < 3 GROUP BY 1")
def join_late_hits(s, d):
    hits = load_table(s, d, "embeddings").where("label < 3").select(F.col("vec_id").alias("doc_id"))
    return J.newest_per_key(docs(s, d).join(hits, "doc_id").select("source", "doc_id"), ["source"], [F.col("doc_id")])


_TURN = r"SELECT source_identity AS k, sequence AS seq FROM journal_observations"


@q(
    "join_neighbors",
    f"WITH r AS ({_TURN}), a AS (SELECT *, row_number() OVER (ORDER BY seq) AS anchor_pos FROM r WHERE seq % 97 = 0), j AS (SELECT r.k, r.seq, anchor_pos, r.seq - a.seq AS distance, row_number() OVER (PARTITION BY r.k, r.seq ORDER BY anchor_pos, abs(r.seq - a.seq), r.seq - a.seq) AS n FROM r JOIN a ON r.k = a.k AND r.seq BETWEEN a.seq - 2 AND a.seq + 2 AND r.seq <> a.seq) SELECT k, seq, anchor_pos, distance FROM j WHERE n = 1 AND seq % 97 <> 0",
)
def join_neighbors(s, d):
    rows = journal(s, d).select(F.col("source_identity").alias("k"), F.col("sequence").alias("seq"))
    anchors = blocked_row_number(rows.where("seq % 97 = 0"), [], [F.col("seq")], "anchor_pos")
    return fusion.neighbours(anchors, rows, "k", "seq", 2).select("k", "seq", F.col("anchor_pos").cast("long").alias("anchor_pos"), F.col("distance").cast("long").alias("distance"))


q("join_hash_dedupe", "SELECT sequence FROM journal_observations a WHERE sequence > 200 AND content_hash NOT IN (SELECT content_hash FROM journal_observations WHERE sequence <= 200 AND content_hash IS NOT NULL)")(
    lambda s, d: journal(s, d).where("sequence > 200 and content_hash is not null").join(journal(s, d).where("sequence <= 200").select("content_hash"), "content_hash", "left_anti").select("sequence")
)


@q(
    "join_newer_evidence",
    "WITH c AS (SELECT source, max(indexed_at) AS through FROM documents WHERE doc_id % 10 = 0 GROUP BY 1) SELECT d.doc_id FROM documents d JOIN c USING (source) WHERE d.indexed_at > c.through",
)
def join_newer_evidence(s, d):
    through = docs(s, d).where("doc_id % 10 = 0").groupBy("source").agg(F.max("indexed_at").alias("through"))
    return docs(s, d).join(through, "source").where("indexed_at > through").select("doc_id")


@q("join_anchor_facts", r"SELECT doc_id, 'gap' AS fact FROM documents WHERE regexp_matches(text, 'cursor') AND regexp_matches(text, 'without a gap') UNION ALL SELECT doc_id, 'lease' FROM documents WHERE regexp_matches(text, '(?i)lease \w+')")
def join_anchor_facts(s, d):
    anchors = s.createDataFrame([("gap", "cursor"), ("gap", "without a gap"), ("lease", r"(?i)lease \w+")], "fact string, pattern string")
    return J.anchored_facts(docs(s, d), anchors, "doc_id", "text")


@q("join_parity", "WITH a AS (SELECT content_hash, count(*) AS n FROM journal_observations WHERE sequence % 3 < 2 GROUP BY 1), b AS (SELECT content_hash, count(*) AS n FROM journal_observations WHERE sequence % 3 > 0 GROUP BY 1) SELECT content_hash, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b USING (content_hash) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def join_parity(s, d):
    rows = journal(s, d)
    return J.multiset_difference(rows.where("sequence % 3 < 2").select("content_hash"), rows.where("sequence % 3 > 0").select("content_hash"))


@q("join_gold_merge", "WITH o AS (SELECT vec_id AS qid, label FROM embeddings WHERE vec_id < 60), n AS (SELECT vec_id AS qid, label + 100 AS label FROM embeddings WHERE vec_id BETWEEN 50 AND 80) SELECT coalesce(n.qid, o.qid) AS qid, coalesce(n.label, o.label) AS label, CASE WHEN n.qid IS NULL THEN 'kept' WHEN o.qid IS NULL THEN 'added' ELSE 'replaced' END AS status FROM o FULL JOIN n ON o.qid = n.qid")
def join_gold_merge(s, d):
    e = load_table(s, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return J.merge_by_key(e.where("qid < 60"), e.where("qid between 50 and 80").withColumn("label", F.col("label") + 100), "qid", ["label"])


@q("join_paired_systems", "SELECT a.o_custkey, round(sum(b.o_totalprice) - sum(a.o_totalprice), 2) AS diff FROM (SELECT o_custkey, sum(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey, sum(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (o_custkey) GROUP BY 1")
def join_paired_systems(s, d):
    o = load_table(s, d, "orders")
    side = lambda r, n: o.where(f"o_orderkey % 2 = {r}").groupBy("o_custkey").agg(F.sum("o_totalprice").alias(n))
    return side(0, "a").join(side(1, "b"), "o_custkey").select("o_custkey", F.round(F.col("b") - F.col("a"), 2).alias("diff"))


@q(
    "join_star",
    "SELECT r_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
)
def join_star(s, d):
    t = lambda n: load_table(s, d, n)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = t("lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    per = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("v").alias("v"))
    out = per.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return out.groupBy("r_name", "p_brand").agg(F.round(F.sum("v"), 2).alias("volume"))


# --- aggregates ---
q("agg_stats_totals", "SELECT count(*) AS docs, sum(size_bytes)::BIGINT AS bytes, count_if(is_compressed = 1) AS compressed FROM documents")(
    lambda s, d: docs(s, d).agg(F.count(F.lit(1)).alias("docs"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("is_compressed") == 1).alias("compressed"))
)
q("agg_by_archive", "SELECT source, count(*) AS n FROM documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source"))
q("agg_by_extension_top20", "SELECT extension, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, extension NULLS FIRST LIMIT 20")(
    lambda s, d: docs(s, d).groupBy("extension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("extension").asc_nulls_first()).limit(20)
)
q("agg_manifest_state", "SELECT source, count(*) AS docs, count_if(is_compressed = 1) AS compressed, coalesce(sum(size_bytes), 0)::BIGINT AS stored_bytes, CASE WHEN count(*) = count_if(is_compressed = 1) THEN 'compressed' WHEN count_if(is_compressed = 1) > 0 THEN 'hybrid (' || count_if(is_compressed = 1) || '/' || count(*) || ')' ELSE 'uncompressed' END AS state FROM documents GROUP BY 1")(
    lambda s, d: A.manifest_state(docs(s, d))
)
q("agg_archive_listing", "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS text_bytes, coalesce(sum(size_bytes), 0)::BIGINT AS stored_bytes, round(coalesce(sum(size_bytes), 0) / sum(strlen(text)), 6) AS ratio, round(sum(strlen(text)) / count(*), 6) AS density FROM documents GROUP BY 1 HAVING sum(strlen(text)) > 0")(
    lambda s, d: docs(s, d)
    .groupBy("source")
    .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("text_bytes"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes"))
    .where("text_bytes > 0")
    .withColumns({"ratio": F.round(F.col("stored_bytes") / F.col("text_bytes"), 6), "density": F.round(F.col("text_bytes") / F.col("n"), 6)})
)
q("agg_dataset_stats", "SELECT origin_db, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (origin_db, source)")(
    lambda s, d: docs(s, d).rollup("origin_db", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
)
q("agg_analyze", "SELECT extension, lang, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM documents GROUP BY GROUPING SETS ((extension, lang), ())")(
    lambda s, d: A.with_totals(docs(s, d), ["extension", "lang"], [F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")])
)
q("agg_archive_stamp", "SELECT source, count(*) || ':' || max(doc_id) AS stamp FROM documents GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("source").agg(F.concat_ws(":", F.count(F.lit(1)), F.max("doc_id")).alias("stamp"))
)
q("agg_source_identity", "SELECT source_identity, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, count(*) AS n FROM journal_observations GROUP BY 1")(lambda s, d: A.source_identity(journal(s, d)))
q("agg_conflicts", "SELECT logical_turn_key, count(DISTINCT content_hash) AS variants, count(*) AS n FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY 1 HAVING count(DISTINCT content_hash) > 1")(lambda s, d: A.conflicts(journal(s, d)))
_TK = r"regexp_extract_all(coalesce(user_text, ''), '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b')"
q("agg_dominant_ticket", f"WITH t AS (SELECT session_id, unnest(list_distinct({_TK})) AS ticket FROM journal_observations WHERE session_id IS NOT NULL), c AS (SELECT session_id, ticket, count(*) AS n FROM t GROUP BY ALL) SELECT session_id, arg_min(ticket, (-n, ticket)) AS ticket, max(n) AS n, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING max(n) >= ceil(0.5 * sum(n))")(
    lambda s, d: A.dominant(journal(s, d).where("session_id is not null").select("session_id", F.explode(T.tickets(F.col("user_text"))).alias("ticket")), ["session_id"], "ticket", 0.5, strict=False)
)
q("agg_topic_dominant", "WITH r AS (SELECT source_identity, mode, row_number() OVER (PARTITION BY source_identity ORDER BY sequence) AS k FROM journal_observations WHERE trim(mode) <> ''), c AS (SELECT source_identity, mode, count(*) AS n FROM r WHERE k <= 10 GROUP BY ALL) SELECT source_identity, arg_min(mode, (-n, mode)) AS mode, max(n) AS n, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING max(n) >= ceil(0.5 * sum(n))")(
    lambda s, d: A.dominant(fusion.top_per_group(journal(s, d).where("trim(mode) <> ''").select("source_identity", "mode", "sequence"), ["source_identity"], [F.col("sequence")], 10), ["source_identity"], "mode", 0.5, strict=False)
)
q("agg_document_frequency", r"WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_#./-]{2,}'))) AS token FROM documents) SELECT token, count(*) AS df FROM t GROUP BY 1")(
    lambda s, d: docs(s, d).select(F.explode(F.array_distinct(coverage_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
)
q("agg_observations_by_ticket", f"SELECT ticket, count(*) AS n, max(sequence) AS newest FROM (SELECT sequence, unnest(list_distinct({_TK})) AS ticket FROM journal_observations) GROUP BY 1")(
    lambda s, d: journal(s, d).select("sequence", F.explode(T.tickets(F.col("user_text"))).alias("ticket")).groupBy("ticket").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("newest"))
)
q("agg_latest_time", "SELECT source, epoch_us(max(indexed_at)) AS latest_us FROM documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source").agg(F.unix_micros(F.max("indexed_at")).alias("latest_us")))
q("agg_metric_mean", "SELECT event_type, round(avg(value), 6) AS mean_value, count(value) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")(
    lambda s, d: A.with_totals(load_table(s, d, "events"), ["event_type"], [F.round(F.avg("value"), 6).alias("mean_value"), F.count("value").alias("n")])
)
q("agg_gold_status", "SELECT count(*) AS queries, count_if(label >= 2) AS relevant, count_if(label = 0) AS g0, count_if(label = 1) AS g1, count_if(label = 2) AS g2 FROM embeddings")(
    lambda s, d: load_table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("label") >= 2).alias("relevant"), *[F.count_if(F.col("label") == g).alias(f"g{g}") for g in (0, 1, 2)])
)
q("agg_percentile_nearest", "SELECT event_type, list_sort(list(value))[greatest(1, least(count(value), round(0.95 * count(value) + 0.5)::BIGINT))] AS percentile FROM events GROUP BY 1")(
    lambda s, d: A.percentile_nearest(load_table(s, d, "events"), ["event_type"], "value", 0.95)
)
q("agg_turn_statistics", "SELECT session_id, count(*) AS turns, sum(strlen(coalesce(assistant_text, '')))::BIGINT AS bytes, min(sequence) AS first_seq, max(sequence) AS last_seq, CASE WHEN count(*) >= 150 THEN 'long' WHEN count(*) >= 60 THEN 'medium' ELSE 'short' END AS size FROM journal_observations WHERE session_id IS NOT NULL GROUP BY 1")(
    lambda s, d: journal(s, d)
    .where("session_id is not null")
    .groupBy("session_id")
    .agg(F.count(F.lit(1)).alias("turns"), F.sum(F.octet_length(F.coalesce("assistant_text", F.lit("")))).alias("bytes"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"))
    .withColumn("size", F.when(F.col("turns") >= 150, "long").when(F.col("turns") >= 60, "medium").otherwise("short"))
)
q("agg_mean_summary", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean_price, median(l_quantity) AS median_quantity, count_if(l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2")(
    lambda s, d: load_table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.median("l_quantity").alias("median_quantity"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))
)
q("agg_chatlog_totals", "SELECT tier, count(*) AS raw, count(DISTINCT turn_hash) AS uniq, count(*) - count(DISTINCT turn_hash) AS duplicates FROM journal_observations WHERE turn_hash IS NOT NULL GROUP BY 1")(
    lambda s, d: journal(s, d).where("turn_hash is not null").groupBy("tier", "turn_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("tier").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("uniq"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
)

# --- windows ---
_CANON = "SELECT sequence FROM journal_observations WHERE logical_turn_key IS NULL OR trim(logical_turn_key) = '' UNION ALL SELECT arg_min(sequence, (source_fidelity_rank, -sequence)) FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY logical_turn_key"


def canonical(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Best row per logical turn (lowest fidelity rank, then newest) and all rows without a key.

    A grouped minimum with map-side combination instead of a window: a hot key costs one
    row per task.
    """
    keyed = F.trim("logical_turn_key") != ""
    best = rows.where(keyed).groupBy("logical_turn_key").agg(F.min_by(F.struct(*columns), F.struct("source_fidelity_rank", -F.col("sequence"))).alias("r")).select("r.*")
    return best.unionByName(rows.where(~F.coalesce(keyed, F.lit(False))).select(*columns))


q("win_canonical", _CANON)(lambda s, d: canonical(journal(s, d), ["sequence"]))
q("set_union_all_canonical", f"SELECT count(*) AS n, sum(sequence)::BIGINT AS total FROM ({_CANON})")(lambda s, d: canonical(journal(s, d), ["sequence"]).agg(F.count(F.lit(1)).alias("n"), F.sum("sequence").alias("total")))
q("join_canonical_rank", "SELECT o.logical_turn_key, max(o.sequence) AS sequence FROM journal_observations o JOIN (SELECT logical_turn_key, min(source_fidelity_rank) AS best FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY 1) r ON o.logical_turn_key = r.logical_turn_key AND o.source_fidelity_rank = r.best GROUP BY 1")(
    lambda s, d: journal(s, d).where(F.trim("logical_turn_key") != "").groupBy("logical_turn_key").agg(F.min_by("sequence", F.struct("source_fidelity_rank", -F.col("sequence"))).alias("sequence"))
)


@q("win_hash_chain", "WITH c AS (SELECT sequence, prior_event_hash, lag(event_hash) OVER (ORDER BY sequence) AS expected, lag(sequence) OVER (ORDER BY sequence) AS prior FROM journal_observations) SELECT count(*) AS n, count_if(coalesce(expected, '') <> prior_event_hash) AS broken, count_if(sequence - prior > 1) AS gaps FROM c")
def win_hash_chain(s, d):
    """Each row meets its predecessor by number: an equality join instead of one global window."""
    rows = journal(s, d).select("sequence", "prior_event_hash", "event_hash")
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected"), F.lit(True).alias("has"))
    first = rows.agg(F.min("sequence")).scalar()
    j = rows.join(before, "sequence", "left")
    gap = F.col("has").isNull() & (F.col("sequence") > first)
    broken = F.coalesce("expected", F.lit("")) != F.col("prior_event_hash")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("broken"), F.count_if(gap).alias("gaps"))


q("win_sequence_alloc", "SELECT observation_id, (SELECT max(sequence) FROM journal_observations) + row_number() OVER (ORDER BY observation_id) AS new_sequence FROM journal_observations")(
    lambda s, d: blocked_row_number(journal(s, d).select("observation_id"), [], [F.col("observation_id")], "k")
    .select("observation_id", (journal(s, d).agg(F.max("sequence")).scalar() + F.col("k")).alias("new_sequence"))
)


@q("win_timestamp_interpolate", "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(ts) END AS t FROM events), w AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e) SELECT event_id, coalesce(t, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b + (a - b) // 2 ELSE coalesce(b, a) END) AS t_us FROM w")
def win_timestamp_interpolate(s, d):
    """A lost time is the middle of its nearest readable neighbours, carried over blocks from both sides."""
    t = F.when(F.col("event_id") % 4 != 0, F.unix_micros(F.col("ts").cast("timestamp")))
    e = load_table(s, d, "events").select("user_id", "event_id", t.alias("t"))
    known = lambda at: F.when(F.col("t").isNotNull(), F.struct(at.alias("at"), F.col("t").alias("t")))
    e = blocked_running_max(e, ["user_id"], [F.col("event_id")], known(F.col("event_id")), "b")
    e = blocked_running_max(e, ["user_id"], [F.col("event_id").desc()], known(-F.col("event_id")), "a")
    b, a = F.col("b")["t"], F.col("a")["t"]
    mid = F.when(a.isNotNull() & b.isNotNull(), b + F.floor((a - b) / 2)).otherwise(F.coalesce(b, a))
    return e.select("event_id", F.coalesce(F.col("t"), mid).alias("t_us"))


q("win_latest_by_category", "SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")(lambda s, d: J.newest_per_key(docs(s, d).select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id").desc()]))
q("win_capsule_pick", "SELECT source, arg_max(doc_id, (n_chars, doc_id)) AS longest, arg_min(doc_id, (n_chars, doc_id)) AS shortest FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")(
    lambda s, d: docs(s, d).where("n_chars is not null").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"), F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"))
)


@q("win_uncovered_ranges", "WITH r AS (SELECT source_identity, source_byte_offset AS a, source_byte_offset + strlen(coalesce(raw_payload, '')) AS b, sequence FROM journal_observations WHERE source_byte_offset IS NOT NULL), w AS (SELECT *, coalesce(max(b) OVER (PARTITION BY source_identity ORDER BY a, b, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM r) SELECT source_identity, covered AS gap_start, a AS gap_end FROM w WHERE a > covered")
def win_uncovered_ranges(s, d):
    from corvidex.operators.journal import uncovered_ranges

    rows = journal(s, d).where("source_byte_offset is not null").select("source_identity", F.col("source_byte_offset").alias("a"), (F.col("source_byte_offset") + F.octet_length(F.coalesce("raw_payload", F.lit("")))).alias("b"), "sequence")
    return uncovered_ranges(rows, "source_identity", "a", "b", "sequence")


q("win_prefix_budget", "WITH w AS (SELECT session_id, sequence, strlen(coalesce(assistant_text, '')) AS n, coalesce(sum(strlen(coalesce(assistant_text, ''))) OVER (PARTITION BY session_id ORDER BY sequence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM journal_observations WHERE session_id IS NOT NULL) SELECT session_id, sequence, before::BIGINT AS used_before FROM w WHERE before + n <= 800")(
    lambda s, d: fusion.pack_budget(journal(s, d).where("session_id is not null").select("session_id", "sequence", F.octet_length(F.coalesce("assistant_text", F.lit(""))).alias("n")), ["session_id"], [F.col("sequence").desc()], "n", 800, skip=False).select("session_id", "sequence", "used_before")
)
q("win_window_split", "SELECT doc_id, count(*) AS n_windows FROM (SELECT doc_id, unnest(range(0, (greatest(0, ceil((length(text) - 900) / 675.0)) + 1)::BIGINT)) FROM documents WHERE length(text) > 0) GROUP BY 1")(
    lambda s, d: fusion.passages(docs(s, d).select("doc_id", "text"), ["doc_id"], "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"))
)
def _hits(s: SparkSession, d: str) -> DataFrame:
    """Documents with a vector, numbered within their archive."""
    rows = docs(s, d).select("source", "doc_id").join(load_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return blocked_row_number(rows, ["source"], [F.col("doc_id")], "rank").withColumn("rank", F.col("rank").cast("long"))


q("win_first_hit_rank", "WITH r AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents JOIN embeddings ON vec_id = doc_id) SELECT source, min(rank) FILTER (WHERE label = 1) AS first_hit FROM r GROUP BY 1")(
    lambda s, d: _hits(s, d).groupBy("source").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).cast("long").alias("first_hit"))
)
q("win_new_facts_gain", "WITH r AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents JOIN embeddings ON vec_id = doc_id), f AS (SELECT source, label, min(rank) AS rank FROM r GROUP BY 1, 2) SELECT source, rank, count(*) AS new_facts FROM f GROUP BY 1, 2")(
    lambda s, d: _hits(s, d).groupBy("source", "label").agg(F.min("rank").alias("rank")).groupBy("source", "rank").agg(F.count(F.lit(1)).alias("new_facts"))
)

# --- sorts and top-k ---
q("top_facets", r"SELECT doc_id FROM documents ORDER BY CASE source WHEN 'worklog:state' THEN 0 WHEN 'worklog:chunks' THEN 1 WHEN 'chat:turns' THEN 2 ELSE 3 END, doc_id DESC, file_path LIMIT 40")(
    lambda s, d: docs(s, d).orderBy(F.when(F.col("source") == "worklog:state", 0).when(F.col("source") == "worklog:chunks", 1).when(F.col("source") == "chat:turns", 2).otherwise(3), F.col("doc_id").desc(), "file_path").limit(40).select("doc_id")
)
q("top_authoritative", "SELECT doc_id, source FROM documents WHERE source LIKE 'worklog:%' ORDER BY CASE source WHEN 'worklog:state' THEN 0 ELSE 1 END, is_compressed, doc_id DESC LIMIT 30")(
    lambda s, d: docs(s, d).where("source like 'worklog:%'").orderBy(F.when(F.col("source") == "worklog:state", 0).otherwise(1), "is_compressed", F.col("doc_id").desc()).limit(30).select("doc_id", "source")
)
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
_CONF = "CASE WHEN lower(event_time_confidence) IN ('exact', 'local') THEN 3 WHEN lower(event_time_confidence) IN ('date-only', 'date_only') THEN 2 ELSE 1 END"
q("top_turn_evidence", f"SELECT sequence FROM journal_observations ORDER BY {_CONF} DESC, coalesce(CASE WHEN regexp_matches(event_time, '{_ISO}') THEN epoch_us(event_time::TIMESTAMPTZ) END, 0) DESC, sequence DESC LIMIT 30")(
    lambda s, d: journal(s, d)
    .withColumns({"at_us": F.when(F.col("event_time").rlike(_ISO), F.unix_micros(F.try_to_timestamp("event_time"))), "path": F.lit("")})
    .orderBy(*EV.evidence_order("event_time_confidence", "at_us", "sequence", "path"))
    .limit(30)
    .select("sequence")
)
q("top_stable_partition", "SELECT doc_id FROM documents WHERE source IS NOT NULL ORDER BY CASE WHEN source = 'worklog:state' THEN 0 ELSE 1 END, doc_id LIMIT 60")(
    lambda s, d: docs(s, d).where("source is not null").orderBy(F.when(F.col("source") == "worklog:state", 0).otherwise(1), "doc_id").limit(60).select("doc_id")
)
q("srt_files", "SELECT doc_id FROM documents ORDER BY size_bytes DESC NULLS LAST, file_name, doc_id LIMIT 50")(
    lambda s, d: docs(s, d).orderBy(F.col("size_bytes").desc_nulls_last(), "file_name", "doc_id").limit(50).select("doc_id")
)
q("top_federated", "WITH r AS (SELECT origin_db, doc_id, n_chars, row_number() OVER (PARTITION BY origin_db ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents) SELECT origin_db, doc_id FROM r ORDER BY 1.0 / (60 + k) DESC, k, origin_db, doc_id LIMIT 40")(
    lambda s, d: fusion.top_per_group(docs(s, d).select("origin_db", "doc_id", "n_chars"), ["origin_db"], [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], 50, "k").orderBy((1.0 / (60 + F.col("k"))).desc(), "k", "origin_db", "doc_id").limit(40).select("origin_db", "doc_id")
)

# --- sets ---
_POOL = lambda s, d: docs(s, d).where("source = 'worklog:state'").select(F.col("doc_id").alias("stable_id"), F.lit(0).alias("pool_order"), F.col("doc_id").alias("position")).unionByName(docs(s, d).where("origin_db = 'worklogs.db'").select(F.col("doc_id").alias("stable_id"), F.lit(1).alias("pool_order"), (-F.col("doc_id")).alias("position")))
_POOL_SQL = "p AS (SELECT doc_id AS stable_id, 0 AS pool_order, doc_id AS position FROM documents WHERE source = 'worklog:state' UNION ALL SELECT doc_id, 1, -doc_id FROM documents WHERE origin_db = 'worklogs.db')"
q("set_merge_pools", f"WITH {_POOL_SQL} SELECT stable_id, min(pool_order) AS pool_order FROM p GROUP BY 1")(lambda s, d: fusion.merge_pools(_POOL(s, d)).select("stable_id", "pool_order"))
q("set_merge_lexical", f"WITH {_POOL_SQL}, m AS (SELECT stable_id, arg_min((pool_order, position), (pool_order, position)) AS o FROM p GROUP BY 1) SELECT stable_id FROM m ORDER BY o LIMIT 100")(lambda s, d: fusion.merge_pools(_POOL(s, d), limit=100).select("stable_id"))
q("set_merge_candidate", "SELECT session_id, arg_min(outcome_summary, sequence) FILTER (WHERE outcome_summary IS NOT NULL) AS outcome_summary, arg_min(mode, sequence) FILTER (WHERE mode IS NOT NULL) AS mode FROM journal_observations WHERE session_id IS NOT NULL GROUP BY 1")(
    lambda s, d: fusion.merge_fields(journal(s, d).where("session_id is not null"), "session_id", ["sequence"], ["outcome_summary", "mode"])
)


@q("set_coverage_splice", "WITH l AS (SELECT doc_id, source = 'chat:turns' AS chat, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS pos FROM documents QUALIFY pos <= 200), ch AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS pick FROM documents WHERE source = 'chat:turns' QUALIFY pick <= 30), sl AS (SELECT pos, row_number() OVER (ORDER BY pos) AS pick FROM l WHERE chat), a AS (SELECT doc_id, pos AS place FROM l WHERE NOT coalesce(chat, false) UNION ALL SELECT ch.doc_id, coalesce(sl.pos, 1048576 + ch.pick) FROM ch LEFT JOIN sl USING (pick) UNION ALL SELECT doc_id, 2097152 + pos FROM l WHERE chat AND doc_id NOT IN (SELECT doc_id FROM ch)) SELECT doc_id, row_number() OVER (ORDER BY place, doc_id) AS pos FROM a")
def set_coverage_splice(s, d):
    """The newest turns take the places of the turns among the longest documents."""
    order = [F.col("n_chars").desc_nulls_last(), F.col("doc_id")]
    top = docs(s, d).orderBy(*order).limit(200).select(F.col("doc_id").alias("stable_id"), F.row_number().over(Window.orderBy(*order)).alias("pos"))
    chat = docs(s, d).where("source = 'chat:turns'").select("doc_id")
    chosen = chat.orderBy(F.col("doc_id").desc()).limit(30).withColumn("pick", F.row_number().over(Window.orderBy(F.col("doc_id").desc())))
    out = splice(top, chat.join(F.broadcast(top.select(F.col("stable_id").alias("doc_id"))), "doc_id", "left_semi"), chosen)
    return out.select(F.col("stable_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"))


q("set_list_diff", "SELECT doc_id FROM documents WHERE is_compressed = 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")(
    lambda s, d: docs(s, d).where("is_compressed = 0").select("doc_id").exceptAll(load_table(s, d, "embeddings").select("vec_id"))
)
q("set_subtract_known", "SELECT file_path FROM documents WHERE source LIKE 'chat:%' EXCEPT SELECT file_path FROM documents WHERE source = 'chat:dross'")(
    lambda s, d: docs(s, d).where("source like 'chat:%'").select("file_path").distinct().join(docs(s, d).where("source = 'chat:dross'").select("file_path"), "file_path", "left_anti")
)
q("set_multiset_equal", "SELECT (SELECT count(*) FROM (SELECT turn_hash FROM journal_observations EXCEPT ALL SELECT turn_hash FROM journal_observations)) = 0 AS equal")(
    lambda s, d: J.multiset_difference(journal(s, d).select("turn_hash"), journal(s, d).select("turn_hash")).agg((F.count(F.lit(1)) == 0).alias("equal"))
)
q("set_distinct_docs", "SELECT DISTINCT origin_db, source, extension FROM documents")(lambda s, d: docs(s, d).select("origin_db", "source", "extension").distinct())
q("set_gained_lost", "WITH x AS (SELECT user_id, sum(value) FILTER (WHERE event_id % 2 = 0) AS a, sum(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT count_if(b > a) AS wins, count_if(b < a) AS losses, count_if(a = b) AS ties FROM x")(
    lambda s, d: load_table(s, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b")).agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
)
q("snk_json_rows", "SELECT doc_id, json_extract_string(to_json({'id': doc_id, 'db': origin_db, 'archive': source, 'path': file_path}), '$.path') AS path_back FROM documents WHERE file_path IS NOT NULL")(
    lambda s, d: docs(s, d).where("file_path is not null").select("doc_id", F.get_json_object(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("origin_db").alias("db"), F.col("source").alias("archive"), F.col("file_path").alias("path"))), "$.path").alias("path_back"))
)
q("snk_manifest_upsert", "WITH n AS (SELECT source AS source_archive, count(*)::INT AS ingested_documents, NULL::VARCHAR AS content_hash FROM documents WHERE source LIKE 'chat:%' GROUP BY 1) SELECT coalesce(n.source_archive, m.source_archive) AS source_archive, CASE WHEN n.source_archive IS NOT NULL THEN n.ingested_documents ELSE m.ingested_documents END AS ingested_documents, coalesce(n.content_hash, m.content_hash) AS content_hash FROM ingestion_manifest m FULL JOIN n ON n.source_archive = m.source_archive")(
    lambda s, d: J.coalesce_upsert(manifest(s, d), docs(s, d).where("source like 'chat:%'").groupBy(F.col("source").alias("source_archive")).agg(F.count(F.lit(1)).cast("int").alias("ingested_documents")).withColumn("content_hash", F.lit(None).cast("string")), "source_archive", ["ingested_documents"], ["content_hash"])
)
QUERIES, ORACLE = R.queries, R.oracle
