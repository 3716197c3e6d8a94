"""Queries of the registered functions and of scalar function families, and of ticket capsules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.functions.registered import register
from corvidex.operators import gold, tickets
from corvidex.queries.common import Registry
from corvidex.queries.relational import docs, journal
from corvidex.sources import worklog

R = Registry()
q = R.query


def _sql(sql: str, **views):
    """A query of SQL over registered functions, run on named tables."""

    def run(s: SparkSession, d: str) -> DataFrame:
        register(s)
        for name, table in views.items():
            table(s, d).createOrReplaceTempView(f"surface_{name}")
        return s.sql(sql)

    return run


q("udtf_split_passages", "WITH x AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, text, n, unnest(range(0, (greatest(0, ceil((n - 900) / 675.0)) + 1)::BIGINT)) AS i FROM x) SELECT doc_id, i AS passage_no, i * 675 AS char_start, least(i * 675 + 900, n) AS char_end, md5(substring(text, i * 675 + 1, 900)) AS passage_md5 FROM p")(
    _sql("SELECT doc_id, passage_no, char_start, char_end, md5(passage) AS passage_md5 FROM surface_docs, LATERAL split_passages(text)", docs=lambda s, d: docs(s, d).select("doc_id", "text"))
)
q("udtf_parse_worklog", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^={80}\n([^\n]*\S[^\n]*)\n={80}$', 1)) FROM documents WHERE source = 'worklog:state') GROUP BY 1")(
    _sql("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, heading, min(start_line) AS l FROM surface_docs, LATERAL parse_worklog(text) WHERE heading NOT IN ('EVIDENCE') AND NOT (heading = 'TICKET SUMMARY' AND start_line = 1 AND NOT startswith(text, repeat('=', 80))) GROUP BY doc_id, heading, body) GROUP BY doc_id", docs=lambda s, d: docs(s, d).where("source = 'worklog:state'").select("doc_id", "text"))
)
q("udtf_parse_chatlog", r"SELECT sequence, trim(regexp_replace(user_text, '\s+', ' ', 'g'), ' ') AS user_text FROM journal_observations WHERE regexp_matches(user_text, '[^\s]') AND regexp_matches(assistant_text, '[^\s]')")(
    _sql("SELECT sequence, user_text FROM surface_log, LATERAL parse_chatlog(text)", log=lambda s, d: journal(s, d).where(F.col("user_text").rlike(r"[^\s]") & F.col("assistant_text").rlike(r"[^\s]")).select("sequence", F.concat(F.lit("--- PROMPT LOG ENTRY ---\nUSER: "), T.one_line(F.col("user_text")), F.lit("\nASSISTANT: "), T.one_line(F.col("assistant_text")), F.lit("\n--- END PROMPT LOG ENTRY ---")).alias("text")))
)
q("udf_overlap_score", "SELECT doc_id, round(len(list_filter(['cursor', 'lease', 'queue'], lambda w: list_contains(regexp_extract_all(replace(replace(replace(lower(strip_accents(coalesce(text, ''))), 'ł', 'l'), 'đ', 'd'), 'ø', 'o'), '[\\p{L}\\p{N}_]+'), w))) / 3.0, 4) AS score FROM documents")(
    _sql("SELECT doc_id, overlap_score('cursor lease queue', text) AS score FROM surface_docs", docs=lambda s, d: docs(s, d).select("doc_id", "text"))
)
q("udf_zlib", "SELECT doc_id, md5(text) AS back_md5 FROM documents WHERE text IS NOT NULL")(
    _sql("SELECT doc_id, md5(zlib_inflate(zlib_deflate(text))) AS back_md5 FROM surface_docs", docs=lambda s, d: docs(s, d).where("text is not null").select("doc_id", "text"))
)

# --- scalar families ---
q("fn_string", r"SELECT doc_id, upper(file_name) AS up, trim('  ' || coalesce(file_name, '') || ' ', ' ') AS trimmed, replace(file_path, '/', '|') AS swapped, substring(file_path, 2, 5) AS part, contains(file_path, 'turns') AS has_turns, starts_with(file_name, 'turn-') AS is_turn, instr(file_path, '/') AS slash, length(file_path) AS n_chars, strlen(file_path) AS n_bytes, lpad(doc_id::VARCHAR, 6, '0') AS padded, len(string_split(file_path, '/')) AS depth, concat_ws(':', origin_db, source) AS joined, file_path ILIKE '%TURN%' AS liked FROM documents")(
    lambda s, d: docs(s, d).select(
        "doc_id", F.upper("file_name").alias("up"), F.trim(F.concat(F.lit("  "), F.coalesce("file_name", F.lit("")), F.lit(" "))).alias("trimmed"), F.replace("file_path", F.lit("/"), F.lit("|")).alias("swapped"), F.substring("file_path", 2, 5).alias("part"),
        F.contains("file_path", F.lit("turns")).alias("has_turns"), F.startswith("file_name", F.lit("turn-")).alias("is_turn"), F.instr("file_path", "/").alias("slash"), F.char_length("file_path").alias("n_chars"), F.octet_length("file_path").alias("n_bytes"),
        F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("padded"), F.size(F.split("file_path", "/")).alias("depth"), F.concat_ws(":", "origin_db", "source").alias("joined"), T.like(F.col("file_path"), "%TURN%").alias("liked"),
    )
)
_JAVA = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(%s, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) %% 4294967296)"
q("fn_hash", f"WITH h AS (SELECT doc_id, file_path, {_JAVA % 'file_path'} AS w FROM documents WHERE file_path <> '') SELECT doc_id, substring(sha1(file_path), 1, 16) AS sha1_16, sha256(file_path) AS sha256, substring(md5(file_path), 1, 8) AS md5_8, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS java_hash, lower(hex(file_path)) AS hex FROM h")(
    lambda s, d: docs(s, d).where("file_path <> ''").select("doc_id", F.substring(F.sha1("file_path"), 1, 16).alias("sha1_16"), F.sha2("file_path", 256).alias("sha256"), F.substring(F.md5(F.encode("file_path", "UTF-8")), 1, 8).alias("md5_8"), gold.java_hash(F.col("file_path")).alias("java_hash"), F.lower(F.hex(F.encode("file_path", "UTF-8"))).alias("hex"))
)
q("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events WHERE props IS NOT NULL")(lambda s, d: _json(s, d))


def _json(s: SparkSession, d: str) -> DataFrame:
    from corvidex.session import load_table

    e = load_table(s, d, "events").where("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


# --- tickets ---
def _chunks(s: SparkSession, d: str) -> DataFrame:
    return worklog.parse_worklogs(docs(s, d).where("source like 'worklog:%'").select(F.col("doc_id").cast("string").alias("path"), "text"))


@q("snk_capsule")
def snk_capsule(s, d):
    """Rendered capsules of all tickets of the worklogs, within their bytes."""
    return tickets.capsules(_chunks(s, d))


@q("wl_ticket_index")
def wl_ticket_index(s, d):
    return tickets.ticket_index(_chunks(s, d))


@q("wl_active", "SELECT 'ORB-' || sequence AS ticket, coalesce(mode, 'open') AS phase, outcome_summary AS next_action, CASE WHEN impact = 'high' THEN 1 ELSE 0 END AS n_blockers, recorded_at AS updated_at FROM journal_observations WHERE NOT coalesce(tier = 'dross', false)")
def wl_active(s, d):
    """Open tickets among state files made of the journal's rows; an older state of each is there too."""
    blockers = F.array(F.struct(F.when(F.col("impact") == "high", "open").otherwise("resolved").alias("status"), F.lit("x").alias("description")))
    key = F.concat(F.lit("ORB-"), F.col("sequence").cast("string"))
    state = F.struct(key.alias("ticket_key"), F.when(F.col("tier") == "dross", "closed").otherwise("open").alias("lifecycle"), F.col("mode").alias("phase"), F.col("outcome_summary").alias("next_action"), F.col("recorded_at").alias("updated_at"), blockers.alias("blockers"))
    older = F.struct(key.alias("ticket_key"), F.lit("open").alias("lifecycle"), F.lit("old").alias("phase"))
    rows = journal(s, d).where("recorded_at > ''")
    states = rows.select(F.to_json(state).alias("text")).unionByName(rows.select(F.to_json(older).alias("text"))).unionByName(s.createDataFrame([("no json",), ("{}",)], "text string"))
    found = tickets.active_tickets(states)
    return found.select("ticket", "phase", "next_action", "n_blockers", "updated_at")


QUERIES, ORACLE = R.queries, R.oracle
