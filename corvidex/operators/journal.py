"""The event journal: normalisation, keys, hashes, ranges, verification and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.text import content_hash, is_handoff_noise, turn_hash
from corvidex.operators.ordering import blocked_running_max

# fixed values: fidelity ranks of the kinds of sources
FIDELITY = {"native_transcript": 1, "deterministic_hook": 2, "rule_write": 3, "rule_summary": 4, "parser_backfill": 5}
SPILL_BYTES = 8192


def uncovered_ranges(spans: DataFrame, group: str, start: str, end: str, unique: str) -> DataFrame:
    """Gaps between byte spans of a group, from 0; spans may overlap.

    What is covered so far is a running maximum over blocks, so a source with a large part
    of all spans is many tasks' work.
    """
    covered = blocked_running_max(spans, [group], [F.col(start), F.col(end), F.col(unique)], F.col(end).cast("long"), "__covered")
    covered = covered.withColumn("gap_start", F.coalesce("__covered", F.lit(0).cast("long")))
    return covered.where(F.col(start) > F.col("gap_start")).select(group, "gap_start", F.col(start).cast("long").alias("gap_end"))


def chain_report(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: rows, gaps in the numbers, broken links, wrong hashes, turns with differing contents.

    A row after a gap has no predecessor to be linked to, so it counts as a gap and not as a
    broken link.
    """
    first = rows.agg(F.min("sequence")).scalar()
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected"), F.lit(True).alias("has"))
    j = rows.join(before, "sequence", "left")
    gap = F.col("has").isNull() & (F.col("sequence") > first)
    link = ~gap & (F.coalesce("expected", F.lit("")) != F.coalesce("prior_event_hash", F.lit("")))
    wrong = event_hash(F.col("prior_event_hash"), fields) != F.col("event_hash")
    told = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps"), F.count_if(link).alias("broken"), F.count_if(wrong).alias("wrong_hashes"))
    turns = rows.where(F.trim("logical_turn_key") != "").groupBy("logical_turn_key").agg(F.count_distinct("content_hash").alias("v"))
    return told.withColumn("conflicts", turns.where("v > 1").agg(F.count(F.lit(1))).scalar())


def idempotency_key() -> Column:
    """What makes a recorded event the same event again; NULL if nothing does."""
    located = F.coalesce(F.col("source_byte_offset") > 0, F.lit(False)) | F.coalesce(F.col("source_start_line") > 0, F.lit(False)) | F.coalesce(F.col("source_end_line") > 0, F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    place = F.concat(zero("source_byte_offset"), F.lit(":"), zero("source_start_line"), F.lit(":"), zero("source_end_line"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    src = F.col("source_identity")
    return (
        F.when(has("prompt_id"), F.concat(src, F.lit("::prompt::"), F.col("prompt_id")))
        .when(has("session_id") & located, F.concat(src, F.lit("::"), F.col("session_id"), F.lit("::"), place))
        .when(located, F.concat(src, F.lit("::locator::"), place))
        .when(has("session_id"), F.concat(src, F.lit("::session::"), F.col("session_id"), F.lit("::"), F.coalesce("recorded_at", F.lit(""))))
    )


def logical_turn_key() -> Column:
    start, end = (F.coalesce(F.col(c), F.lit(0)) for c in ("source_start_line", "source_end_line"))
    return F.when(F.col("prompt_id") != "", F.col("prompt_id")).when(
        (start > 0) | (end > 0), F.concat("source_identity", F.lit("#"), start.cast("string"), F.lit("-"), end.cast("string"))
    )


def normalize_events(events: DataFrame) -> DataFrame:
    """Defaults, keys and hashes of incoming events, and ``problem`` for what cannot be recorded.

    An event needs a source and at least one of its two texts; others are kept apart by
    their ``problem`` instead of failing the job. Unknown source kinds rank last.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rank = F.lit(5)
    for kind, r in FIDELITY.items():
        rank = F.when(F.col("source_kind") == kind, r).otherwise(rank)
    problem = F.when(blank("source_identity"), "no source").when(blank("user_text") & blank("assistant_text"), "no text")
    return events.withColumns(
        {
            "source_fidelity_rank": F.coalesce("source_fidelity_rank", rank),
            "logical_turn_key": F.coalesce(F.when(~blank("logical_turn_key"), F.col("logical_turn_key")), logical_turn_key()),
            "idempotency_key": idempotency_key(),
            "content_hash": content_hash(F.col("user_text"), F.col("assistant_text")),
            "turn_hash": turn_hash(F.col("user_text"), F.col("assistant_text")),
            "problem": problem,
        }
    )


def record_once(existing: DataFrame, incoming: DataFrame, key: str = "idempotency_key", order: str = "sequence") -> DataFrame:
    """Incoming events that are new: the first of each key, and all without a key."""
    keyed = incoming.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    fresh = first.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*incoming.columns)
    return fresh.unionByName(incoming.where(F.col(key).isNull()))


def event_hash(prior: Column, fields: list[str]) -> Column:
    """Hash of an event and its predecessor's hash; NULL fields count as absent."""
    return F.sha2(F.concat(F.coalesce(prior, F.lit("")), F.lit("\n"), F.to_json(F.struct(*fields))), 256)


def verify_chain(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose stored hash or link is wrong: ``sequence, bad_link, bad_hash``.

    The predecessor is found by number in an equality join, so verification runs in
    parallel over a journal of any length; creating a chain is sequential by nature.
    """
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected"))
    j = rows.join(before, "sequence", "left")
    bad_link = F.coalesce("expected", F.lit("")) != F.coalesce("prior_event_hash", F.lit(""))
    bad_hash = event_hash(F.col("prior_event_hash"), fields) != F.col("event_hash")
    return j.select("sequence", bad_link.alias("bad_link"), bad_hash.alias("bad_hash")).where("bad_link or bad_hash")


def impact(text: str) -> Column:
    """high, low or none, from the labelled sections of an answer."""
    t = F.coalesce(F.col(text), F.lit(""))
    label = lambda names: t.rlike(rf"(?m)^\s*(?:#+\s*)?(?:{names})\b")
    # fixed values: labels of changes and of findings
    denied = t.rlike(r"(?im)^\s*(?:#+\s*)?(?:FILES CHANGED|REMOTE CHANGES)\s*:?\s*\n?\s*(?:none|no|n/a)\b")
    high = label("SEMANTIC COMMIT TITLE|WRITE GATE") | (label("FILES CHANGED|REMOTE CHANGES") & ~denied)
    low = label("FINDINGS?|VERIFICATION|VALIDATION|ROOT CAUSE|RESULT|CONCLUSION|RECOMMENDATION|EXECUTION|DECISION")
    return F.when(high, "high").when(low, "low").otherwise("none")


def project(canonical: DataFrame, cursor: int, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Documents of canonical rows after a cursor: hand-off noise and dross are dropped, long
    texts are split into a turn with a pointer and an artifact with the whole text."""
    body = F.concat(F.lit("## User\n\n"), F.coalesce("user_text", F.lit("")), F.lit("\n\n## Assistant\n\n"), F.coalesce("assistant_text", F.lit("")))
    rows = canonical.where(F.col("sequence") > cursor).withColumns({"body": body, "impact": impact("assistant_text")})
    rows = rows.where(~is_handoff_noise(F.col("body")) & (F.coalesce("tier", F.lit("turns")) != "dross"))
    long = F.octet_length("body") > spill_bytes
    short = F.concat(F.substring("body", 1, 400), F.lit("\n\n(see artifact-"), F.lpad(F.col("sequence").cast("string"), 6, "0"), F.lit(".md)"))
    turn = F.struct(F.lit("turns").alias("tier"), F.when(long, short).otherwise(F.col("body")).alias("text"))
    artifact = F.when(long, F.struct(F.lit("artifacts").alias("tier"), F.col("body").alias("text")))
    docs = rows.select("sequence", "impact", F.explode(F.filter(F.array(turn, artifact), lambda x: x.isNotNull())).alias("x"))
    name = F.format_string("%s-%06d.md", F.when(F.col("x.tier") == "turns", "turn").otherwise("artifact"), F.col("sequence"))
    return docs.select("sequence", "impact", "x.tier", name.alias("file_name"), "x.text")


def snapshots(sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``source_identity, sha256, size_bytes, content`` of contents not stored yet, each once.

    ``sources``: ``source_identity, content`` (binary); ``known``: snapshots already stored.
    The bytes are kept as they are; the digest tells whether they came back unchanged.
    """
    rows = sources.where("content is not null").select("source_identity", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "content")
    if known is not None:
        rows = rows.join(known.select("source_identity", "sha256"), ["source_identity", "sha256"], "left_anti")
    return rows.dropDuplicates(["source_identity", "sha256"])
