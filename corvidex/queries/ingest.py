"""Queries of sources, sinks, conversation and worklog parsing, streaming and administration.

Files are made from table rows in a folder of the session (the checkpoint folder, which all
executors share), so that the file operators run on real files.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import fts, gold, passages
from corvidex.operators import journal as JR
from corvidex.operators.ordering import blocked_row_number
from corvidex.operators.timestamps import normalise_timestamps
from corvidex.plans import planner as P
from corvidex.queries.common import Registry
from corvidex.queries.relational import docs, journal
from corvidex.session import cut_lineage, ensure_checkpoint_dir, load_table
from corvidex.sources import chatlog, files, protocol, registry, sinks, transcripts, worklog
from corvidex.streaming import journal as SJ
from corvidex.streaming.sweep import sweep

R = Registry()
q = R.query


def _folder(s: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/corvidex-{what}-{uuid.uuid4().hex}"


# --- sources ---
def _content(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where("content is not null").select("doc_id", "file_name", "extension", F.encode("content", "UTF-8").alias("content"), F.octet_length("content").cast("long").alias("size_bytes"))


q("src_decode", "SELECT doc_id, md5(content) AS text_md5 FROM documents WHERE content IS NOT NULL")(lambda s, d: _content(s, d).select("doc_id", F.md5(files.decode(F.col("content"))).alias("text_md5")))
q("src_binary_sniff", "SELECT doc_id, doc_id % 7 = 0 AS is_binary FROM documents WHERE content IS NOT NULL")(
    lambda s, d: _content(s, d).select("doc_id", files.is_binary(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"ab\0"), F.col("content"))).otherwise(F.col("content"))).alias("is_binary"))
)
q("src_text_extract", "SELECT extension, count(*) AS n FROM documents WHERE content IS NOT NULL GROUP BY 1")(lambda s, d: files.extract_text(_content(s, d)).where("text is not null").groupBy("extension").agg(F.count(F.lit(1)).alias("n")))


def _zipped(batches):
    for f in batches:
        rows = []
        for name, text in zip(f["file_name"], f["content"], strict=True):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr(f"in/{name}", bytes(text))
            rows.append(buf.getvalue())
        yield pd.DataFrame({"path": f["doc_id"].astype(str) + ".zip", "content": rows})


q("src_zip_entries", "SELECT doc_id || '.zip' AS archive, 'in/' || file_name AS file_path, strlen(content) AS size_bytes FROM documents WHERE content IS NOT NULL")(
    lambda s, d: files.archive_entries(_content(s, d).mapInPandas(_zipped, "path string, content binary")).select("archive", "file_path", "size_bytes")
)
q("src_archive_stage", "SELECT count(*) AS n, 0::BIGINT AS damaged FROM documents WHERE content IS NOT NULL")(
    lambda s, d: files.archive_entries(_content(s, d).mapInPandas(_zipped, "path string, content binary")).agg(F.count(F.lit(1)).alias("n"), F.count("problem").alias("damaged"))
)
q("src_rar_7z", "SELECT doc_id || '.rar' AS archive, 'unsupported archive kind' AS problem FROM documents WHERE content IS NOT NULL")(
    lambda s, d: files.archive_entries(_content(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".rar")).alias("path"), "content")).select("archive", "problem")
)
q("src_pdf", "SELECT doc_id, NULL::VARCHAR AS text FROM documents WHERE content IS NOT NULL")(
    lambda s, d: files.extract_text(_content(s, d).withColumn("extension", F.lit(".pdf"))).select("doc_id", "text")
)


@q("src_dir_scan", "SELECT count(*) AS n_files, coalesce(sum(strlen(content)), 0)::BIGINT AS n_bytes FROM documents WHERE content IS NOT NULL")
def src_dir_scan(s, d):
    """All contents written as text files, one each, and found again by scanning the folder."""
    path = _folder(s, "files")
    rows = docs(s, d).where("content is not null")
    rows.select(F.col("doc_id"), F.base64(F.encode("content", "UTF-8")).alias("c")).foreachPartition(_files_writer(path))
    return files.dir_scan(s, path, "*.txt").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def _files_writer(path: str):
    folder = path.removeprefix("file:").replace("//", "/")

    def write(rows):
        import base64
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/{r.doc_id}.txt", "wb") as f:
                f.write(base64.b64decode(r.c))

    return write


@q("src_stdin_append", "SELECT origin_db, source, file_path, md5(string_agg(coalesce(file_name, ''), chr(10) ORDER BY doc_id) || chr(10) || 'typed text') AS body_md5 FROM documents WHERE source = 'live_events' GROUP BY 1, 2, 3")
def src_stdin_append(s, d):
    """Typed text appended to every living document."""
    keys = ["origin_db", "source", "file_path"]
    live = docs(s, d).where("source = 'live_events'").select(*keys, F.col("doc_id").alias("chunk_no"), F.coalesce("file_name", F.lit("")).alias("chunk"))
    none = live.limit(0).select(*keys, F.col("chunk").alias("content"))
    stored = sinks.append_text(none, live)
    typed = stored.select(*keys, F.lit(1).cast("long").alias("chunk_no"), F.lit("typed text").alias("chunk"))
    return sinks.append_text(stored, typed).select(*keys, F.md5("content").alias("body_md5"))


@q("src_gold_jsonl", "SELECT vec_id::VARCHAR AS qid, label AS grade FROM embeddings")
def src_gold_jsonl(s, d):
    """Labelled queries written as JSON lines and read with the declared schema."""
    path = _folder(s, "gold")
    e = load_table(s, d, "embeddings")
    label = F.array(F.struct(F.lit("d").alias("doc"), F.col("label").alias("rel")))
    e.select(F.col("vec_id").cast("string").alias("qid"), F.lit("K").alias("class"), F.lit("dev").alias("split"), label.alias("labels")).write.json(path)
    return files.gold_labels(files.gold_queries(s, path)).select("qid", "grade")


q("src_vectors", "SELECT vec_id, label FROM embeddings WHERE label = 2")(lambda s, d: load_table(s, d, "embeddings").where("label = 2").select("vec_id", "label"))
def _registry(s: SparkSession, d: str) -> registry.Registry:
    """A registry file of the databases in the table; datasets made, changed and dropped in it."""
    found = [r[0] for r in docs(s, d).where("origin_db is not null").select("origin_db").distinct().orderBy("origin_db").collect()]
    folder = ensure_checkpoint_dir(s).removeprefix("file:").replace("//", "/")
    r = registry.Registry(f"{folder}/datasets-{uuid.uuid4().hex}.json", found)
    r.create("all", found)
    r.create("work", found[:2])
    r.add_database("work", found[-1])
    r.remove_database("work", found[0])
    r.create("gone", found)
    r.delete("gone")
    r.rename("work", "worklog")
    r.use("worklog")
    return r


def _registered(r: registry.Registry) -> list[tuple]:
    data = r.load()
    return [(n, b, n == data["active_dataset"]) for n, v in data["datasets"].items() if n != "default" for b in v["databases"]]


_FOUND = "f AS (SELECT origin_db, row_number() OVER (ORDER BY origin_db) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT origin_db FROM documents WHERE origin_db IS NOT NULL))"
_SETS = f"WITH {_FOUND} SELECT 'all' AS dataset, origin_db, false AS active FROM f UNION ALL SELECT 'worklog', origin_db, true FROM f WHERE (k <= 2 OR k = n) AND k > 1"
q("adm_dataset_crud", _SETS)(lambda s, d: s.createDataFrame(_registered(_registry(s, d)), "dataset string, origin_db string, active boolean"))
q("snk_registry", _SETS)(lambda s, d: s.createDataFrame(_registered(registry.Registry(_registry(s, d).path)), "dataset string, origin_db string, active boolean"))


@q("src_registry", f"WITH {_FOUND} SELECT origin_db, count(*) AS n FROM documents WHERE origin_db IN (SELECT origin_db FROM f WHERE (k <= 2 OR k = n) AND k > 1) GROUP BY 1")
def src_registry(s, d):
    """Documents of the active dataset of a registry file."""
    active = _registry(s, d).databases()
    return docs(s, d).where(F.col("origin_db").isin(active)).groupBy("origin_db").agg(F.count(F.lit(1)).alias("n"))


@q("adm_name_safety", r"SELECT DISTINCT coalesce(file_name, '') AS name, regexp_full_match(coalesce(file_name, ''), '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AND NOT contains(coalesce(file_name, ''), '..') AS safe FROM documents")
def adm_name_safety(s, d):
    """Which file names could name a database."""

    def one(frames):
        for f in frames:
            out = []
            for n in f["name"]:
                try:
                    registry.safe_name(n)
                    out.append(True)
                except registry.RegistryError:
                    out.append(False)
            f["safe"] = out
            yield f

    return docs(s, d).select(F.coalesce("file_name", F.lit("")).alias("name")).distinct().mapInPandas(one, "name string, safe boolean")


def _logs(s: SparkSession, d: str) -> DataFrame:
    return journal(s, d).select(F.col("sequence").cast("string").alias("path"), F.col("raw_payload").alias("text"))


@q("src_chatlog")
def src_chatlog(s, d):
    """Raw payloads parsed as prompt logs."""
    return chatlog.parse_logs(_logs(s, d)).select("source_path", "byte_offset", "start_line", "end_line", "dialect", "user", "assistant")


_LOG_TEXT = r"trim(regexp_replace(coalesce(%s, ''), '\s+', ' ', 'g'), ' ')"
_ENTRY_SQL = f"e AS (SELECT sequence, {_LOG_TEXT % 'user_text'} AS u, {_LOG_TEXT % 'assistant_text'} AS a FROM journal_observations)"


def _fenced(s: SparkSession, d: str) -> DataFrame:
    """Journal rows as fenced log entries, ten to a file, with one line per speaker."""
    line = lambda c: T.one_line(F.coalesce(c, F.lit("")))
    block = F.concat(F.lit("--- PROMPT LOG ENTRY ---\nTIMESTAMP: "), F.col("sequence").cast("string"), F.lit("\nUSER: "), line("user_text"), F.lit("\nASSISTANT: "), line("assistant_text"), F.lit("\n--- END PROMPT LOG ENTRY ---"))
    rows = journal(s, d).select("sequence", block.alias("b"))
    per = rows.groupBy(F.floor(F.col("sequence") / 10).cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("sequence", "b"))).alias("x"))
    return per.select("path", F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("text"))


q("chat_fields", f"WITH {_ENTRY_SQL} SELECT sequence::VARCHAR AS stamp, md5(u) AS user_md5, md5(a) AS assistant_md5 FROM e WHERE u <> '' OR a <> ''")(
    lambda s, d: chatlog.parse_logs(_fenced(s, d)).where("dialect = 'Fenced'").select(F.col("raw_timestamp").alias("stamp"), F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5")).unionByName(_unasked(s, d))
)


def _unasked(s: SparkSession, d: str) -> DataFrame:
    """Entries without a prompt are artifacts: their whole text is the answer, so it is cut out again here."""
    rows = chatlog.parse_logs(_fenced(s, d)).where("dialect = 'Artifact'")
    stamp = F.regexp_extract("raw_body", r"(?m)^TIMESTAMP: (\d+)$", 1)
    said = F.trim(F.regexp_extract("raw_body", r"(?m)^ASSISTANT: ?(.*)$", 1))
    return rows.where(said != "").select(stamp.alias("stamp"), F.md5(F.lit("")).alias("user_md5"), F.md5(said).alias("assistant_md5"))


q("chat_split_regions", "SELECT (sequence // 10)::VARCHAR AS source_path, count(*) AS n FROM journal_observations GROUP BY 1")(
    lambda s, d: chatlog.parse_logs(_fenced(s, d)).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
)
q("chat_roles", f"WITH {_ENTRY_SQL} SELECT CASE WHEN u <> '' THEN 'Fenced' ELSE 'Artifact' END AS dialect, count(*) AS n FROM e GROUP BY 1")(
    lambda s, d: chatlog.parse_logs(_fenced(s, d)).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))
)


@q("chat_classify")
def chat_classify(s, d):
    """Entries per dialect. A text line with a label of its own ("KEY-1: ...") is a field, as in the logs."""
    return chatlog.parse_logs(_logs(s, d)).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))


@q("chat_sections")
def chat_sections(s, d):
    return chatlog.parse_logs(_logs(s, d)).select("source_path", F.explode("sections").alias("label", "body"))


q("src_worklog", "SELECT doc_id::VARCHAR AS source_path FROM documents WHERE source LIKE 'worklog:%' AND regexp_matches(text, '\\S')")(
    lambda s, d: worklog.parse_worklogs(docs(s, d).where("source like 'worklog:%'").select(F.col("doc_id").cast("string").alias("path"), "text")).select("source_path").distinct()
)
_HEAD = r"regexp_extract_all(text, '(?m)^={80}\n([^\n]*\S[^\n]*)\n={80}$', 1)"
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(upper(h), '{rx}') THEN '{name}'" for name, rx in worklog.CATEGORIES) + " ELSE 'other' END"
q("wl_sections", f"SELECT doc_id::VARCHAR AS source_path, trim(h) AS heading FROM (SELECT doc_id, unnest({_HEAD}) AS h FROM documents WHERE source = 'worklog:state')")(
    lambda s, d: _sections(s, d).select("source_path", "heading")
)
q("wl_category", f"SELECT {_CAT} AS category, count(*) AS n FROM (SELECT unnest({_HEAD}) AS h FROM documents WHERE source = 'worklog:state') GROUP BY 1")(
    lambda s, d: _sections(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
)


def _sections(s: SparkSession, d: str) -> DataFrame:
    """Headed sections of the worklogs that begin with a heading."""
    rows = docs(s, d).where("source = 'worklog:state'").select(F.col("doc_id").cast("string").alias("path"), "text")
    out = worklog.parse_worklogs(rows).where("source_order % 1000 = 0 and heading not in ('EVIDENCE')")
    return out.where("not (heading = 'TICKET SUMMARY' and start_line = 1)")


@q("wl_split")
def wl_split(s, d):
    return worklog.parse_worklogs(docs(s, d).where("source = 'worklog:chunks'").select(F.col("doc_id").cast("string").alias("path"), "text")).select("source_path", "source_order", "category", "start_line", "end_line", F.octet_length("body").alias("bytes"))


@q("wl_latest_time")
def wl_latest_time(s, d):
    return docs(s, d).where("source like 'worklog:%'").select("doc_id", worklog.latest_time(F.col("text")).alias("latest_us"))


q("wl_ticket", r"SELECT doc_id, nullif(regexp_extract(text, '\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b'), '') AS ticket FROM documents WHERE source LIKE 'worklog:%'")(
    lambda s, d: docs(s, d).where("source like 'worklog:%'").select("doc_id", F.get(T.tickets(F.col("text")), F.lit(0)).alias("ticket"))
)
q("wl_authority_state", "SELECT doc_id, CASE source WHEN 'worklog:state' THEN 'state' WHEN 'worklog:chunks' THEN 'authoritative' WHEN 'worklog:evidence' THEN 'evidence' ELSE 'historical' END AS authority FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.when(F.col("source") == "worklog:state", "state").when(F.col("source") == "worklog:chunks", "authoritative").when(F.col("source") == "worklog:evidence", "evidence").otherwise("historical").alias("authority"))
)


@q("src_transcript_claude")
def src_transcript_claude(s, d):
    """Records written back as JSON lines and read as transcripts, one file per session."""
    t = load_table(s, d, "claude_turn").where("sessionid is not null")
    line = F.to_json(F.struct("type", "message", F.col("promptid").alias("promptId"), F.col("sessionid").alias("sessionId"), "timestamp"))
    lines = t.select(F.col("sessionid").alias("path"), F.col("record_no").alias("line_no"), line.alias("line"))
    return transcripts.turns(lines).select("path", "turn", "user_text", "assistant_text")


@q("src_transcript_cursor")
def src_transcript_cursor(s, d):
    t = load_table(s, d, "claude_turn").where("sessionid is not null and type in ('user', 'assistant')")
    line = F.to_json(F.struct(F.col("type").alias("role"), "message"))
    return transcripts.turns(t.select(F.col("sessionid").alias("path"), F.col("record_no").alias("line_no"), line.alias("line"))).select("path", "turn", "user_text", "assistant_text")


_ISO = r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$'"
q("chat_ts_parse", f"SELECT sequence, epoch_us(event_time::TIMESTAMPTZ) AS utc_us FROM journal_observations WHERE regexp_matches(event_time, {_ISO})")(
    lambda s, d: normalise_timestamps(journal(s, d).where(F.col("event_time").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")).select("sequence", "event_time"), ("event_time",)).select("sequence", F.col("event_time_utc_us").alias("utc_us"))
)

# --- planner ---
_QUERIES = ("what did we decide about the retry budget?", "dlaczego kolejka była pusta", 'exact "phrase here" OR x*', "core/A.java", "foo-bar AND content:x.y", "fix ABC-12 now", "ABC-1 OR DEF-2")


def _values(columns: str, *rows: tuple) -> str:
    """Rows worked out by hand from the rules of the planner."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


_Q = dict(zip("what pl phrase path column ticket two".split(), _QUERIES, strict=True))
_PL = "kolejka OR kole* OR kołejka OR kołe* OR pusta OR pust*"
q("fts_plan", _values(
    "query, strict, relaxed, explicit, language",
    (_Q["what"], _Q["what"], "decide OR deci* OR retry OR retr* OR budget OR budg*", False, "en"), (_Q["pl"], _Q["pl"], _PL, False, "pl"),
    (_Q["phrase"], _Q["phrase"], None, True, "en"), (_Q["path"], _Q["path"], '"core/A.java"', False, "en"), (_Q["column"], _Q["column"], None, True, "en"),
    (_Q["ticket"], _Q["ticket"], 'fix OR "ABC-12"', False, "en"), (_Q["two"], _Q["two"], None, True, "en"),
))(lambda s, d: s.createDataFrame([(x, p.strict, p.relaxed, p.explicit, p.language) for x in _QUERIES for p in [P.plan_query(x)]], "query string, strict string, relaxed string, explicit boolean, language string"))
q("fts_normalize_query", _values(
    "query, normal", (_Q["what"], 'what did we decide about the retry "budget?"'), (_Q["pl"], _Q["pl"]), (_Q["phrase"], _Q["phrase"]), (_Q["path"], '"core/A.java"'),
    (_Q["column"], '"foo-bar" AND content:"x.y"'), (_Q["ticket"], 'fix "ABC-12" now'), (_Q["two"], '"ABC-1" OR "DEF-2"'),
))(lambda s, d: s.createDataFrame([(x, P.normalize_query(x)) for x in _QUERIES], "query string, normal string"))
q("fts_is_explicit", _values("query, explicit", *[(x, x in (_Q["phrase"], _Q["column"], _Q["two"])) for x in _QUERIES]))(lambda s, d: s.createDataFrame([(x, P.is_explicit(x)) for x in _QUERIES], "query string, explicit boolean"))
q("fts_relax_terms", _values(
    "query, terms", (_Q["what"], 'what OR did OR we OR decide OR deci* OR about OR abou* OR the OR retry OR retr* OR "budget?"'),
    (_Q["pl"], f"dlaczego OR dlacz* OR dłaczego OR dłacz* OR {_PL.replace(' OR pusta', ' OR była OR pusta')}"), (_Q["phrase"], 'exact OR exac* OR """phrase" OR "here""" OR or OR "x*"'), (_Q["path"], '"core/A.java"'),
    (_Q["column"], '"foo-bar" OR and OR "content:x.y"'), (_Q["ticket"], 'fix OR "ABC-12" OR now'), (_Q["two"], '"ABC-1" OR or OR "DEF-2"'),
))(lambda s, d: s.createDataFrame([(x, " OR ".join(P.relax_terms(x.split(), True))) for x in _QUERIES], "query string, terms string"))
q("fts_language_guess", _values("query, language", *[(x, "pl" if x == _Q["pl"] else "en") for x in _QUERIES]))(lambda s, d: s.createDataFrame([(x, P.language_guess(x.split())) for x in _QUERIES], "query string, language string"))
q("fts_parse_ticket", _values("query, ticket, rest", *[(x, "ABC-12", "fix now") if x == _Q["ticket"] else (x, None, x) for x in _QUERIES]))(lambda s, d: s.createDataFrame([(x, *P.split_ticket(x)) for x in _QUERIES], "query string, ticket string, rest string"))
q("rnk_generic_query", _values("query, is_generic", ("current status overview", True), *[(x, False) for x in _QUERIES]))(lambda s, d: s.createDataFrame([(x, P.is_generic(x.split())) for x in ("current status overview", *_QUERIES)], "query string, is_generic boolean"))


# --- sinks ---
@q("snk_insert_doc", "SELECT origin_db, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def snk_insert_doc(s, d):
    path = _folder(s, "docs")
    sinks.insert_documents(docs(s, d).select("doc_id", "origin_db", "source", "n_chars"), path)
    return s.read.parquet(path).groupBy("origin_db").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@q("snk_sync_directory", "SELECT source, CASE WHEN source = 'chat:dross' THEN sum(n_chars)::BIGINT * 2 ELSE sum(n_chars)::BIGINT END AS chars FROM documents GROUP BY 1")
def snk_sync_directory(s, d):
    """One archive is reloaded, the others stay."""
    path = _folder(s, "sync")
    rows = docs(s, d).select("doc_id", "origin_db", "source", F.col("n_chars").cast("long").alias("n_chars"))
    sinks.insert_documents(rows, path)
    sinks.replace_archives(rows.where("source = 'chat:dross'").withColumn("n_chars", F.col("n_chars") * 2), path)
    return s.read.parquet(path).groupBy("source").agg(F.sum("n_chars").alias("chars"))


q("snk_compress", "SELECT doc_id, md5(content) AS back_md5 FROM documents WHERE content IS NOT NULL")(
    lambda s, d: docs(s, d).where("content is not null").select("doc_id", F.md5(sinks.inflate(sinks.deflate(F.col("content")))).alias("back_md5"))
)
q("snk_export_log", "SELECT sequence, 'TIMESTAMP: ' || coalesce(event_time, '') || chr(10) || 'USER: ' || coalesce(user_text, '') || chr(10) || 'ASSISTANT: ' || coalesce(assistant_text, '') || chr(10) || repeat('=', 80) AS block FROM journal_observations ORDER BY sequence DESC LIMIT 40")(
    lambda s, d: sinks.export_log(journal(s, d), 40)
)


@q("snk_hash_index", "SELECT turn_hash, sequence FROM journal_observations WHERE turn_hash IS NOT NULL")
def snk_hash_index(s, d):
    path = _folder(s, "hashes")
    rows = journal(s, d).where("turn_hash is not null").select("turn_hash", F.lit("p").alias("file_path"), F.col("source_identity").alias("source"), F.col("source_start_line").alias("start_line"), F.col("source_end_line").alias("end_line"), "sequence")
    sinks.write_hash_index(rows, path)
    schema = "turn_hash string, file_path string, source string, start_line int, end_line int, sequence long"
    return s.read.option("sep", "\t").schema(schema).csv(path).select("turn_hash", "sequence")


q("snk_analysis_report", "SELECT count(*) AS n_lines FROM (SELECT extension FROM documents WHERE content IS NOT NULL GROUP BY GROUPING SETS ((extension), (), (extension IS NULL)))")(
    lambda s, d: sinks.analysis_report(files.extract_text(_content(s, d))).agg(F.count(F.lit(1)).alias("n_lines"))
)


@q("snk_eval_run", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk_eval_run(s, d):
    path = _folder(s, "runs")
    sinks.save_eval_run(s, path, "bench", {"depth": 10}, load_table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    return s.read.parquet(path).select(F.get_json_object("metrics_json", "$.event_type").alias("event_type"), F.get_json_object("metrics_json", "$.n").cast("long").alias("n"))


q("snk_worklog_stage", "WITH n AS (SELECT DISTINCT file_path AS out_path FROM documents WHERE source IN ('worklog:state', 'worklog:chunks')), o AS (SELECT DISTINCT file_path AS out_path FROM documents WHERE source IN ('worklog:chunks', 'worklog:evidence')) SELECT coalesce(n.out_path, o.out_path) AS out_path, CASE WHEN n.out_path IS NULL THEN 'delete' WHEN o.out_path IS NULL THEN 'write' ELSE 'keep' END AS action FROM n FULL JOIN o ON n.out_path = o.out_path")(
    lambda s, d: sinks.stage_plan(_outputs(s, d, "worklog:state", "worklog:chunks"), _outputs(s, d, "worklog:chunks", "worklog:evidence"))
)


def _outputs(s: SparkSession, d: str, *sources: str) -> DataFrame:
    return docs(s, d).where(F.col("source").isin(*sources)).select(F.col("file_path").alias("out_path"), F.sha2("file_path", 256).alias("hash")).distinct()


def _stored(s: SparkSession, d: str) -> str:
    path = _folder(s, "store")
    sinks.insert_documents(docs(s, d).select("doc_id", "origin_db", "source", F.col("n_chars").cast("long").alias("n_chars")), path)
    return path


@q("snk_purge_archive", "SELECT source, count(*) AS n FROM documents WHERE source IS DISTINCT FROM 'chat:dross' GROUP BY 1")
def snk_purge_archive(s, d):
    """An archive is dropped from the written store."""
    path = _stored(s, d)
    sinks.purge_archive(s, path, "chat:dross", [r[0] for r in docs(s, d).select("origin_db").distinct().collect()])
    return s.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@q("snk_egest", "SELECT source, count(*) AS n FROM documents WHERE NOT coalesce(source = 'live_events' AND origin_db = (SELECT min(origin_db) FROM documents WHERE source = 'live_events'), false) GROUP BY 1")
def snk_egest(s, d):
    """An archive leaves one of its databases."""
    path = _stored(s, d)
    first = docs(s, d).where("source = 'live_events'").agg(F.min("origin_db")).first()[0]
    sinks.purge_archive(s, path, "live_events", [first] if first else [])
    return s.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@q("snk_rename_archive", "SELECT CASE WHEN source = 'chat:dross' THEN 'chat:rest' ELSE source END AS source, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def snk_rename_archive(s, d):
    path = _stored(s, d)
    sinks.rename_archive(s, path, "chat:dross", "chat:rest")
    return s.read.parquet(path).groupBy("source").agg(F.sum("doc_id").alias("ids"))


q("snk_append_doc", "SELECT origin_db, source, file_path, md5(string_agg(coalesce(file_name, ''), chr(10) ORDER BY doc_id)) AS body_md5 FROM documents GROUP BY 1, 2, 3")(
    lambda s, d: sinks.append_text(docs(s, d).limit(0).select("origin_db", "source", "file_path", "content"), docs(s, d).select("origin_db", "source", "file_path", F.col("doc_id").alias("chunk_no"), F.coalesce("file_name", F.lit("")).alias("chunk"))).select("origin_db", "source", "file_path", F.md5("content").alias("body_md5"))
)


@q("snk_turn_emit", "WITH f AS (SELECT turn_hash, min(sequence) AS canonical FROM journal_observations WHERE turn_hash IS NOT NULL GROUP BY 1) SELECT o.sequence, CASE WHEN o.sequence = canonical THEN 'turn' ELSE 'sighting' END AS kind FROM journal_observations o JOIN f USING (turn_hash)")
def snk_turn_emit(s, d):
    """Every delivered turn, as the canonical one of its hash or as a further sighting."""
    rows = journal(s, d).where("turn_hash is not null").select("turn_hash", "sequence")
    new, seen = sinks.emit_turns(rows, rows.limit(0), ["sequence"])
    return new.select("sequence", F.lit("turn").alias("kind")).unionByName(seen.select("sequence", F.lit("sighting").alias("kind")))


@q("jrn_snapshot", "SELECT DISTINCT source_identity, sha256(raw_payload) AS sha256, strlen(raw_payload)::BIGINT AS size_bytes, true AS unchanged FROM journal_observations WHERE raw_payload IS NOT NULL")
def jrn_snapshot(s, d):
    """Raw payloads stored as bytes, in two deliveries, and read back."""
    path = _folder(s, "snapshots")
    rows = journal(s, d).where("raw_payload is not null")
    of = lambda x: x.select("source_identity", F.encode("raw_payload", "UTF-8").alias("content"))
    JR.snapshots(of(rows.where("sequence % 3 > 0"))).write.parquet(f"{path}/1")
    JR.snapshots(of(rows), s.read.parquet(f"{path}/1")).write.parquet(f"{path}/2")
    back = s.read.parquet(f"{path}/1", f"{path}/2")
    return back.select("source_identity", "sha256", "size_bytes", (F.sha2("content", 256) == F.col("sha256")).alias("unchanged"))


# --- gold sets ---
def _states(s: SparkSession, d: str) -> DataFrame:
    """Ticket states made of journal rows: a decision, a blocker and a next action each."""
    said = lambda c: F.struct(F.lit("1").alias("id"), F.lit("open").alias("status"), F.col(c).alias("description"))
    key = F.concat(F.lit("ORB-"), F.col("sequence").cast("string"))
    state = F.struct(key.alias("ticket_key"), F.col("mode").alias("next_action"), F.array(said("user_text")).alias("decisions"), F.array(said("outcome_summary")).alias("blockers"))
    return journal(s, d).select(F.to_json(state).alias("text"))


_WORDS3 = r"len(list_filter(regexp_split_to_array(coalesce(%s, ''), '\s+'), lambda w: w <> '')) >= 3"
q("ev_gold_candidates", f"SELECT 'ORB-' || sequence AS ticket, ({_WORDS3 % 'user_text'})::INT + ({_WORDS3 % 'outcome_summary'})::INT + ({_WORDS3 % 'mode'})::INT AS n FROM journal_observations WHERE ({_WORDS3 % 'user_text'}) OR ({_WORDS3 % 'outcome_summary'}) OR ({_WORDS3 % 'mode'})")(
    lambda s, d: gold.candidates(_states(s, d)).where("class = 'Q'").groupBy("ticket").agg(F.count(F.lit(1)).cast("int").alias("n"))
)
_JAVA_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(%s, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) %% 4294967296)"
q("ev_gold_split", f"WITH h AS (SELECT event_id, {_JAVA_HASH % 'event_type'} AS w FROM events) SELECT event_id, CASE WHEN abs(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END) % 10 < 7 THEN 'dev' ELSE 'test' END AS split FROM h")(
    lambda s, d: load_table(s, d, "events").select("event_id", gold.split_for(F.col("event_type")).alias("split"))
)


def _gold(s: SparkSession, d: str) -> DataFrame:
    label = F.array(F.struct(F.lit("d").alias("doc"), F.col("label").alias("rel")))
    e = load_table(s, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("qid"), F.when(F.col("label") == 4, "Z").otherwise("K").alias("class"), F.lit("en").alias("lang"), F.when(F.col("vec_id") % 50 == 0, " ").otherwise("words").alias("query"), F.lit("dev").alias("split"), label.alias("labels"))


q("ev_gold_validate", "SELECT problem, count(*) AS n FROM (SELECT 'unknown class' AS problem FROM embeddings WHERE label = 4 UNION ALL SELECT 'no query' FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 'grade out of range' FROM embeddings WHERE label > 3) GROUP BY 1")(
    lambda s, d: files.gold_problems(_gold(s, d)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
)


@q("ev_gold_restore", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def ev_gold_restore(s, d):
    """A version is saved, replaced by one without low grades, and put back."""
    folder = _folder(s, "gold-versions")
    gold.save_version(_gold(s, d), folder, "1")
    gold.save_version(_gold(s, d).where(F.col("labels")[0]["rel"] > 1), folder, "2")
    back = gold.restore(s, folder, "1", "3")
    return back.groupBy(F.col("labels")[0]["rel"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


q("ev_gold_import_status", "SELECT CASE WHEN label = 0 THEN 'added' WHEN label = 1 THEN 'updated' WHEN label = 2 THEN 'kept' ELSE 'unchanged' END AS status, count(*) AS n FROM embeddings GROUP BY 1")(lambda s, d: _imported(s, d))


def _imported(s: SparkSession, d: str) -> DataFrame:
    g = _gold(s, d).withColumn("rel", F.col("labels")[0]["rel"])
    changed = g.withColumn("query", F.when(F.col("rel") == 1, "other").otherwise(F.col("query")))
    return gold.import_set(g.where("rel <> 0").drop("rel"), changed.where("rel <> 2").drop("rel")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


q("ev_gold_status", "SELECT count(*) AS questions, count(*) AS labelled, count_if(label = 0) AS g0, count_if(label = 1) AS g1, count_if(label = 2) AS g2, count_if(label = 3) AS g3 FROM embeddings")(lambda s, d: gold.status(_gold(s, d)))


# --- streaming ---
def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    path = _folder(s, "stream")
    rows = load_table(s, d, table)
    rows.write.parquet(path)
    return SJ.read_parquet_stream(s, path, s.read.parquet(path).schema)


def _through(s: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gave out until it had caught up."""
    out = _folder(s, "out")
    SJ.run_available(df, _folder(s, "offsets"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), mode)
    return s.read.parquet(out)


@q("str_dedupe", "SELECT count(DISTINCT user_id || '-' || event_type) AS n FROM events")
def str_dedupe(s, d):
    e = _stream(s, d, "events").withColumns({"k": F.concat_ws("-", "user_id", "event_type"), "at": F.lit("2026-01-01").cast("timestamp")})
    return _through(s, SJ.record_stream(e, "k", "at")).agg(F.count(F.lit(1)).alias("n"))


@q("str_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_windows(s, d):
    e = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _through(s, SJ.windowed_counts(e, "ts", "1 day", ["event_type"]), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@q("str_lag_tolerance", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str_lag_tolerance(s, d):
    """Sessions of a stream within the lag hold every event once."""
    e = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _through(s, SJ.sessions(e, "ts", "5 minutes", ["event_type"]), "complete").groupBy("event_type").agg(F.sum("n").alias("n"))


@q("str_cursor_projection", "SELECT count(*) AS n FROM journal_observations WHERE coalesce(tier, 'turns') <> 'dross'")
def str_cursor_projection(s, d):
    out = _folder(s, "projected")
    SJ.run_available(_stream(s, d, "journal_observations"), _folder(s, "offsets"), SJ.projecting_sink(out, 1 << 30))
    return s.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


@q("str_transcript_tail")
def str_transcript_tail(s, d):
    t = _stream(s, d, "claude_turn").where("sessionid is not null and type in ('user', 'assistant')")
    return _through(s, SJ.turn_tail(t.select("sessionid", "record_no", F.col("type").alias("role"), F.col("message.content").alias("text"))))


q("str_offset_resume", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 5 END AS resume_at FROM documents WHERE strlen(content) >= 5 AND length(substring(content, 1, 5)) = strlen(substring(content, 1, 5))")(lambda s, d: _resumed(s, d))


def _resumed(s: SparkSession, d: str) -> DataFrame:
    f = docs(s, d).where("octet_length(content) >= 5 and octet_length(substring(content, 1, 5)) = 5")
    now = f.select(F.col("doc_id").cast("string").alias("path"), F.encode("content", "UTF-8").alias("content"))
    head = F.sha2(F.encode(F.substring("content", 1, 5), "UTF-8"), 256)
    state = f.select(F.col("doc_id").cast("string").alias("path"), F.lit(5).cast("long").alias("byte_offset"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(head).alias("prefix_hash"), F.lit(1).alias("parser_version"))
    return SJ.resume_offsets(now, state, 1).select("path", "resume_at")


q("str_change_stamp", "SELECT count(*) || ':' || max(doc_id) AS stamp FROM documents WHERE source = 'chat:turns'")(
    lambda s, d: s.createDataFrame([(SJ.change_stamp(docs(s, d).where("source = 'chat:turns'"), "doc_id"),)], "stamp string")
)
q("str_incremental_index", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")(
    lambda s, d: SJ.incremental_index(docs(s, d).select("doc_id", F.lit(1).alias("h")), load_table(s, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("h")), "doc_id", "h")[0].select("doc_id")
)
_SWEPT = f"o AS (SELECT * FROM journal_observations WHERE trim(coalesce(logical_turn_key, '')) = '' OR sequence IN (SELECT arg_min(sequence, (source_fidelity_rank, -sequence)) FROM journal_observations WHERE trim(logical_turn_key) <> '' GROUP BY logical_turn_key)), b AS (SELECT sequence, tier, '## User' || chr(10) || chr(10) || coalesce(user_text, '') || chr(10) || chr(10) || '## Assistant' || chr(10) || chr(10) || coalesce(assistant_text, '') AS body FROM o), p AS (SELECT *, 1 + (strlen(body) > 8192)::INT AS k FROM b WHERE coalesce(tier, 'turns') <> 'dross' AND NOT (contains(lower(body), 'ai-vault') AND ({' OR '.join(f"contains(lower(body), '{m}')" for m in T.HANDOFF_MARKERS)}))), l AS (SELECT sequence, prior_event_hash, lag(event_hash) OVER (ORDER BY sequence) AS e, lag(sequence) OVER (ORDER BY sequence) AS s FROM journal_observations)"


@q("str_sweep", f"WITH {_SWEPT} SELECT 'reconcile' AS step, (SELECT count(*) FROM o) AS n UNION ALL SELECT 'project', (SELECT sum(k)::BIGINT FROM p) UNION ALL SELECT 'sync', (SELECT sum(k)::BIGINT FROM p) UNION ALL SELECT 'index', (SELECT sum(k)::BIGINT FROM p) UNION ALL SELECT 'worklogs', (SELECT count(*) FROM documents WHERE source LIKE 'worklog:%' AND regexp_matches(text, '\\S')) UNION ALL SELECT 'integrity', (SELECT count_if(sequence - s > 1) + count_if(coalesce(sequence - s, 1) = 1 AND coalesce(e, '') <> coalesce(prior_event_hash, '')) FROM l)")
def str_sweep(s, d):
    """All seven steps of a sweep; the number of capsules is left out, as SQL cannot cut worklogs."""
    from corvidex.queries.relational import canonical

    rows = canonical(journal(s, d), ["sequence", "user_text", "assistant_text", "tier"])
    logs = docs(s, d).where("source like 'worklog:%'").select(F.col("doc_id").cast("string").alias("path"), "text")
    return sweep(s, rows, journal(s, d), logs, _folder(s, "sweep")).where("step <> 'digests'")


@q("str_live_append", "SELECT doc_id FROM documents WHERE source = 'live_events' ORDER BY doc_id")
def str_live_append(s, d):
    """Text appended to living documents is found by a search at once."""
    live = docs(s, d).where("source = 'live_events'").select("origin_db", "source", F.col("doc_id").cast("string").alias("file_path"), F.lit("stored words").alias("content"))
    chunks = live.select("origin_db", "source", "file_path", F.lit(1).cast("long").alias("chunk_no"), F.concat(F.lit("quokkaword "), "file_path").alias("chunk"))
    stored = sinks.append_text(live, chunks).withColumns({"doc_id": F.col("file_path").cast("long"), "file_name": F.lit("")})
    path = _folder(s, "live")
    stored.write.parquet(f"{path}/docs")
    fts.write_index(fts.index_source(s.read.parquet(f"{path}/docs")), f"{path}/index")
    return fts.open_index(s, f"{path}/index").search("quokkaword").select("doc_id")


# --- administration ---
q("adm_validate", "SELECT count(*) AS n_documents, 0 AS refused, ceil(count(*) / 200.0)::BIGINT AS n_requests FROM documents WHERE regexp_matches(text, '\\S')")(lambda s, d: _requests(s, d))


def _requests(s: SparkSession, d: str) -> DataFrame:
    """All passages, checked and put into requests of the allowed size."""
    p = cut_lineage(passages.structured_passages(docs(s, d)).where("passage is not null"))
    batches = protocol.request_batches(p)
    bad = protocol.passage_problems(p.dropDuplicates(["doc_id", "passage_id"])).count()
    return batches.agg(F.count(F.lit(1)).alias("n_documents"), F.lit(bad).alias("refused"), (F.max("batch") + 1).alias("n_requests"))


@q("adm_circuit", "SELECT * FROM (VALUES (0, NULL, 'ValueError: down'), (10, NULL, 'circuit open'), (31, 'ok', NULL), (32, 'ok', NULL)) t(second, answer, reason)")
def adm_circuit(s, d):
    """Four calls to a service that fails once, by a clock of our own."""
    now, out = [0.0], []
    breaker = protocol.CircuitBreaker(30.0, lambda: now[0])

    def ask():
        if now[0] < 1:
            raise ValueError("down")
        return "ok"

    for at in (0, 10, 31, 32):
        now[0] = float(at)
        out.append((at, *breaker.call(ask)))
    return s.createDataFrame(out, "second int, answer string, reason string")


q("jrn_append_only_probe", "SELECT count(*) AS n, count(DISTINCT sequence) AS sequences, max(sequence) - min(sequence) + 1 AS span FROM journal_observations")(
    lambda s, d: journal(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("sequences"), (F.max("sequence") - F.min("sequence") + 1).alias("span"))
)
q("win_line_numbers", "SELECT doc_id, row_number() OVER (PARTITION BY origin_db ORDER BY file_path, doc_id) AS n FROM documents")(
    lambda s, d: blocked_row_number(docs(s, d).select("origin_db", "file_path", "doc_id"), ["origin_db"], [F.col("file_path"), F.col("doc_id")], "n").select("doc_id", F.col("n").cast("long").alias("n"))
)
q("top_maxsim_window", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 3")(
    lambda s, d: load_table(s, d, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.get("embedding", F.lit(0)).desc(), "vec_id"))).where("n <= 3").select("label", "vec_id")
)

QUERIES, ORACLE = R.queries, R.oracle
