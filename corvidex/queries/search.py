"""Full-text queries over ``documents``: the searchable body is ``text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import fts, fusion
from corvidex.plans.planner import plan_query
from corvidex.queries.common import Registry, sql_tokens, text_index
from corvidex.session import load_table

R = Registry()
q = R.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.index_source(_docs(spark, sf_dir), "text", extract=False)


_BASE = f"""WITH d AS (SELECT origin_db, doc_id, {sql_tokens('file_path')} AS tp, {sql_tokens('file_name')} AS tn, {sql_tokens('text')} AS tc FROM documents),
 t AS (SELECT *, len(tp) + len(tn) + len(tc) AS n_tokens FROM d)"""


def _f1(word: str, prefix: bool = False, cols: str = "pnc") -> str:
    test = f"starts_with(x, '{word}')" if prefix else f"x = '{word}'"
    return "(" + " + ".join(f"len(list_filter(t{c}, lambda x: {test}))" for c in cols) + ")"


def _f2(a: str, b: str) -> str:
    return "(" + " + ".join(f"(SELECT count(*) FROM range(len(t{c}) - 1) r(i) WHERE t{c}[i + 1] = '{a}' AND t{c}[i + 2] = '{b}')" for c in "pnc") + ")"


def _ranked(fs: list[str], hit: str, tail: str = "") -> str:
    n = len(fs)
    counts = ", ".join(f"{f} AS f{i}" for i, f in enumerate(fs))
    seen = ", ".join(f"count_if(f{i} > 0) AS n{i}" for i in range(n))
    idf = lambda i: f"CASE WHEN ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) END"
    parts = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))" for i in range(n))
    return f"""{_BASE}, c AS (SELECT origin_db, doc_id, n_tokens, {counts} FROM t),
 s AS (SELECT origin_db, count(*) AS n_docs, avg(n_tokens) AS avg_tokens, {seen} FROM c GROUP BY 1),
 r AS (SELECT c.origin_db, c.doc_id, round(-({parts}), 6) AS score FROM c JOIN s USING (origin_db) WHERE {hit})
 SELECT * FROM r {tail}"""


def _search(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = text_index(spark, sf_dir).search(query)
        return hits.withColumn("score", F.round("score", 6))

    return run


q("fts_bm25", _ranked([_f1("cursor")], "f0 > 0"))(_search("cursor"))
q("fts_and", _ranked([_f1("cursor"), _f1("archive")], "f0 > 0 AND f1 > 0"))(_search("cursor AND archive"))
q("fts_or", _ranked([_f1("zonetable"), _f1("ledgerprojector")], "f0 > 0 OR f1 > 0"))(_search("ZoneTable OR LedgerProjector"))
q("fts_not", _ranked([_f1("retry"), _f1("budget"), _f1("archive")], "f0 > 0 AND f1 > 0 AND NOT f2 > 0"))(_search("retry (budget NOT archive)"))
q("fts_phrase", _ranked([_f2("retry", "budget")], "f0 > 0"))(_search('"retry budget"'))
q("fts_prefix", _ranked([_f1("ledg", True)], "f0 > 0"))(_search("ledg*"))
q("fts_column", _ranked([_f1("turns", cols="p"), _f1("cursor", cols="c")], "f0 > 0 AND f1 > 0"))(_search("file_path:turns AND content:cursor"))
q("fts_relaxed_or", _ranked([_f1("decide"), _f1("deci", True), _f1("retry"), _f1("retr", True)], "f0 > 0 OR f1 > 0 OR f2 > 0 OR f3 > 0"))(
    lambda s, d: _search(plan_query("what did we decide about retry").relaxed)(s, d)
)


@q(
    "fts_near",
    f"""{_BASE}, h AS (SELECT origin_db, doc_id FROM t WHERE EXISTS (
 SELECT 1 FROM range(len(tc)) a(i), range(len(tc)) b(j) WHERE tc[i + 1] = 'cursor' AND tc[j + 1] = 'gap' AND (CASE WHEN j >= i THEN j - i - 1 ELSE i - j - 1 END) <= 5))
 SELECT * FROM h""",
)
def fts_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).search("NEAR(content:cursor content:gap, 5)").select("origin_db", "doc_id")


@q("top_bm25", _ranked([_f1("cursor"), _f1("gap")], "f0 > 0 AND f1 > 0", "ORDER BY score, origin_db, doc_id LIMIT 20"))
def top_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.best(_search("cursor gap")(spark, sf_dir), 20)


@q("fts_index_search", _ranked([_f1("cursor"), _f1("snap", True)], "f0 > 0 AND f1 > 0"))
def fts_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word and a prefix from the index."""
    return _search("cursor AND snap*")(spark, sf_dir)


@q("fts_scan", _ranked([_f1("cursor"), _f2("without", "a")], "f0 > 0 AND f1 > 0"))
def fts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking without an index, from the texts."""
    return fts.search_scan(_source(spark, sf_dir), 'cursor "without a"').withColumn("score", F.round("score", 6))


@q("fts_tokenize", f"SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY 1")
def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    per_doc = rows.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))


@q("fts_index_rebuild", f"""{_BASE}, p AS (SELECT origin_db, doc_id, 'content' AS col, unnest(tc) AS term FROM t UNION ALL SELECT origin_db, doc_id, 'file_name', unnest(tn) FROM t UNION ALL SELECT origin_db, doc_id, 'file_path', unnest(tp) FROM t)
 SELECT origin_db, col, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens FROM (SELECT origin_db, doc_id, col, term, count(*) AS tf FROM p GROUP BY ALL) GROUP BY 1, 2""")
def fts_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the index anew and counts what it holds."""
    rows = text_index(spark, sf_dir, rebuild=True).postings
    return rows.groupBy("origin_db", "col").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").cast("long").alias("n_tokens"))


@q(
    "fts_body_extract",
    r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE text LIKE '%## User%'),
 p AS (SELECT doc_id, body, regexp_replace(regexp_extract(body, '(?s)## User\s*(.*?)(?:\n## Assistant|\z)', 1), '^\s+|\s+$', '', 'g') AS u,
  regexp_replace(regexp_extract(body, '(?s)## Assistant\s*(.*?)(?:\n## Details|\n## Assistant|\z)', 1), '^\s+|\s+$', '', 'g') AS a,
  regexp_replace(regexp_extract(body, '(?s)## Details\s*(.*)', 1), '^\s+|\s+$', '', 'g') AS d FROM b)
 SELECT doc_id, md5(array_to_string(list_filter([u, a, d], lambda x: x <> ''), chr(10))) AS body_md5 FROM p""",
)
def fts_body_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where(F.col("text").contains("## User"))
    return rows.select("doc_id", F.md5(T.search_body(F.col("text"))).alias("body_md5"))


@q(
    "fts_snippet",
    r"""WITH x AS (SELECT doc_id, text, instr(lower(text), 'ledger') AS p FROM documents WHERE text IS NOT NULL),
 w AS (SELECT *, greatest(0, p - 129) AS s, least(length(text), p + 255) AS e, trim(regexp_replace(substring(text, 1, 256), '\s+', ' ', 'g'), ' ') AS head FROM x)
 SELECT doc_id, CASE WHEN p = 0 THEN head || CASE WHEN length(text) > length(head) THEN '...' ELSE '' END ELSE
  regexp_replace(CASE WHEN s > 0 THEN '...' ELSE '' END || trim(regexp_replace(substring(text, (s + 1)::BIGINT, (e - s)::BIGINT), '\s+', ' ', 'g'), ' ') || CASE WHEN e < length(text) THEN '...' ELSE '' END, '(?i)(ledger)', '>>>\1<<<', 'g') END AS snippet FROM w""",
)
def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", T.snippet(F.col("text"), ["ledger"]).alias("snippet"))


@q(
    "fts_preview",
    r"""WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT *, instr(lower(t), 'cursor') AS i FROM x),
 w AS (SELECT doc_id, t, greatest(0, CASE WHEN i > 0 THEN i ELSE 1 END - 1 - 106) AS s FROM p), e AS (SELECT *, least(length(t), s + 320) AS e FROM w)
 SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(t, (s + 1)::BIGINT, (e - s)::BIGINT) || CASE WHEN e < length(t) THEN '…' ELSE '' END AS preview FROM e""",
)
def fts_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.preview(F.col("text"), ["cursor"]).alias("preview"))


@q("fts_fold", f"""SELECT doc_id, md5(replace(replace(replace(lower(strip_accents(file_path)), 'ł', 'l'), 'đ', 'd'), 'ø', 'o')) AS folded FROM documents""")
def fts_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.ascii_fold(F.col("file_path"))).alias("folded"))


@q("fts_stopwords", f"""WITH w AS (SELECT unnest({sql_tokens('text')}) AS token FROM documents) SELECT token, count(*) AS n FROM w
 WHERE replace(token, 'ł', 'l') NOT IN ({', '.join(repr(x) for x in sorted({*T.ENGLISH_STOP_WORDS, *T.POLISH_STOP_WORDS}))}) GROUP BY 1""")
def fts_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.where(~T.ascii_fold(F.col("token")).isin(*{*T.ENGLISH_STOP_WORDS, *T.POLISH_STOP_WORDS})).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@q("fts_search_relaxed")
def fts_search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict hits, completed by the relaxed form when they are few (a decision on the driver)."""
    return fts.relaxed_search(text_index(spark, sf_dir), "where does the ZoneTable ledger stall").withColumn("score", F.round("score", 6))


_TOP50 = "row_number() OVER (PARTITION BY origin_db ORDER BY score, doc_id)"


@q("rnk_federated_rrf", f"WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), r1 AS (SELECT *, {_TOP50} AS sub_rank FROM r0) SELECT origin_db, doc_id, sub_rank, round(1.0 / (60 + sub_rank), 9) AS rrf_score FROM r1 WHERE sub_rank <= 50")
def rnk_federated_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.federated_rrf(_search("cursor")(spark, sf_dir))
    return out.withColumn("rrf_score", F.round("rrf_score", 9))


@q("rnk_pool_bm25", f"WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), r1 AS (SELECT *, {_TOP50} AS pool_rank FROM r0) SELECT origin_db, doc_id, score, pool_rank FROM r1 WHERE pool_rank <= 50")
def rnk_pool_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body pool of each database."""
    return fusion.top_per_group(_search("cursor")(spark, sf_dir), ["origin_db"], [F.col("score"), F.col("doc_id")], 50, "pool_rank")


_POOLS = f"""ex AS (SELECT 'exact' AS signal, doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE file_path ILIKE '%klv%' QUALIFY rank <= 50),
 bm AS (SELECT 'bm25' AS signal, doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM r0 QUALIFY rank <= 50),
 rc AS (SELECT 'recency' AS signal, doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE source = 'chat:turns' QUALIFY rank <= 50),
 au AS (SELECT 'authority' AS signal, doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE source IN ('worklog:state', 'worklog:chunks') QUALIFY rank <= 50),
 pools AS (SELECT * FROM ex UNION ALL SELECT * FROM bm UNION ALL SELECT * FROM rc UNION ALL SELECT * FROM au)"""
_WEIGHT = "CASE signal WHEN 'exact' THEN 4.0 WHEN 'bm25' THEN 3.0 WHEN 'recency' THEN 2.0 WHEN 'authority' THEN 2.0 ELSE 1.0 END"


def topic_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of a topic search, ready to be fused (the id is the document id)."""
    docs = _docs(spark, sf_dir).withColumn("stable_id", F.col("doc_id"))
    hits = _search("cursor")(spark, sf_dir).withColumn("stable_id", F.col("doc_id"))
    newest = [F.col("doc_id").desc()]
    return (
        fusion.ranked_pool(docs.where(T.like(F.col("file_path"), "%klv%")), "exact", newest)
        .unionByName(fusion.ranked_pool(hits, "bm25", [F.col("score"), F.col("doc_id")]))
        .unionByName(fusion.ranked_pool(docs.where("source = 'chat:turns'"), "recency", newest))
        .unionByName(fusion.ranked_pool(docs.where("source in ('worklog:state', 'worklog:chunks')"), "authority", newest))
    )


@q("rnk_rrf", f"WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), {_POOLS} SELECT doc_id, round(sum({_WEIGHT} / (60 + rank)), 9) AS fused_score, count(*) AS n_signals FROM pools GROUP BY 1")
def rnk_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.rrf(topic_pools(spark, sf_dir))
    return out.select(F.col("stable_id").alias("doc_id"), F.round("fused_score", 9).alias("fused_score"), F.size("signals").cast("long").alias("n_signals"))


@q(
    "top_fused",
    f"""WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), {_POOLS}, fu AS (SELECT doc_id, round(sum({_WEIGHT} / (60 + rank)), 9) AS fused_score,
 coalesce(min(rank) FILTER (WHERE signal = 'exact'), 2147483647) AS e, coalesce(min(rank) FILTER (WHERE signal = 'authority'), 2147483647) AS a, coalesce(min(rank) FILTER (WHERE signal = 'recency'), 2147483647) AS c
 FROM pools GROUP BY 1) SELECT doc_id, fused_score FROM fu ORDER BY fused_score DESC, e, a, c, doc_id LIMIT 30""",
)
def top_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.rrf(topic_pools(spark, sf_dir)).withColumn("fused_score", F.round("fused_score", 9))
    return out.orderBy(*fusion.fused_order()).limit(30).select(F.col("stable_id").alias("doc_id"), "fused_score")


@q("win_pool_rank", f"WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), {_POOLS} SELECT signal, doc_id, rank FROM pools")
def win_pool_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_pools(spark, sf_dir).select("signal", F.col("stable_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@q(
    "rnk_add_score_signal",
    f"""WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), {_POOLS}, fu AS (SELECT doc_id, sum({_WEIGHT} / (60 + rank)) AS s FROM pools GROUP BY 1),
 m AS (SELECT doc_id, len(list_filter(['cursor', 'gap', 'lease', 'zone'], lambda w: list_contains({sql_tokens('text')}, w))) / 4.0 AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM fu))
 SELECT doc_id, round(s + 12.0 / 61 / (1 + exp(-score)), 9) AS fused_score FROM fu JOIN m USING (doc_id)""",
)
def rnk_add_score_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(topic_pools(spark, sf_dir)).select("stable_id", "fused_score")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("stable_id"), "text").join(fused.select("stable_id"), "stable_id", "left_semi")
    scored = docs.select("stable_id", fusion.overlap_score(T.tokens(F.col("text")), ["cursor", "gap", "lease", "zone"]).alias("score"))
    out = fusion.add_score_signal(fused, scored, 12.0)
    return out.select(F.col("stable_id").alias("doc_id"), F.round("fused_score", 9).alias("fused_score"))


@q(
    "rnk_rerank",
    f"""WITH r0 AS ({_ranked([_f1('cursor')], 'f0 > 0')}), {_POOLS}, fu AS (SELECT doc_id, sum({_WEIGHT} / (60 + rank)) AS s FROM pools GROUP BY 1),
 m AS (SELECT doc_id, round(len(list_filter(['cursor', 'gap', 'lease', 'zone'], lambda w: list_contains({sql_tokens('text')}, w))) / 4.0, 4) AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM fu)),
 k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM m) SELECT doc_id, round(s + 12.0 / (60 + r), 9) AS fused_score FROM fu JOIN k USING (doc_id)""",
)
def rnk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(topic_pools(spark, sf_dir)).select("stable_id", "fused_score")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("stable_id"), "text").join(fused.select("stable_id"), "stable_id", "left_semi")
    scored = docs.select("stable_id", fusion.overlap_score(T.tokens(F.col("text")), ["cursor", "gap", "lease", "zone"]).alias("score"))
    out = fusion.rerank(fused, scored, "rrf")
    return out.select(F.col("stable_id").alias("doc_id"), F.round("fused_score", 9).alias("fused_score"))


QUERIES, ORACLE = R.queries, R.oracle
