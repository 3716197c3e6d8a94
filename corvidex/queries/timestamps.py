"""Queries of the timestamp operator (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.operators.timestamps import DEFAULT_ZONE, found_timestamps, normalise_timestamps, source_zones, to_canonical
from corvidex.session import load_table

FIELDS = ("event_time", "recorded_at")
#: Zones of sources that do not write in the default zone. Of this data all do.
SOURCE_ZONES: list[tuple[str, str]] = []


def _normalised(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "journal_observations").select("sequence", "source_identity", *FIELDS, *keep)
    overrides = spark.createDataFrame(SOURCE_ZONES, "source_identity string, zone string")
    zones = source_zones(load_table(spark, sf_dir, "journal_source_identities"), "source_identity", DEFAULT_ZONE, overrides)
    return normalise_timestamps(rows, FIELDS, zones, "source_identity", not_after="recorded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_timestamps(_normalised(spark, sf_dir), "sequence", FIELDS)


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with both instants in canonical form, the deserved confidence and the claimed one."""
    df = _normalised(spark, sf_dir, "event_time_confidence")
    claimed = F.lower(F.trim("event_time_confidence"))
    return df.select(
        "sequence",
        to_canonical(F.col("event_time_utc_us")).alias("event_time_utc"),
        F.col("event_time_confidence_found").alias("event_confidence"),
        to_canonical(F.col("recorded_at_utc_us")).alias("recorded_at_utc"),
        F.col("recorded_at_confidence_found").alias("recorded_confidence"),
        F.coalesce(claimed == F.col("event_time_confidence_found"), F.lit(False)).alias("claim_holds"),
    )


_SHAPES = (  # shape, strptime format of the wall clock, how its text is cut out, zone
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(-\d{2}:\d{2})?( |$|Z|[+-]|\()", "%Y-%m-%d %H:%M", "replace(left(t, 16), 'T', ' ')"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S", "replace(left(t, 19), 'T', ' ')"),
    (r"^\d{8}T\d{6}", "%Y%m%dT%H%M%S", "left(t, 15)"),
    (r"^\d{4}/\d{2}/\d{2} ", "%Y/%m/%d %H:%M:%S", "t"),
    (r"^\d{2}\.\d{2}\.\d{4} ", "%d.%m.%Y %H:%M:%S", "t"),
    (r"^[A-Z][a-z]{2}, \d{2} ", "%d %b %Y %H:%M:%S", "substring(t, 6, 20)"),
    (r"^[A-Z][a-z]{2} [A-Z][a-z]{2} +\d+ [0-9:]+ [A-Z]+ \d{4}$", "%b %d %H:%M:%S %Y", r"regexp_replace(regexp_replace(substring(t, 5), ' [A-Z]+ ', ' '), ' +', ' ', 'g')"),
    (r"^[A-Z][a-z]{2} \d+, \d{4} ", "%b %d, %Y %I:%M:%S %p", "t"),
    (r"^\d+ \S+ \d{4}, \d{2}:\d{2}$", "%d %m %Y, %H:%M", "{polish}"),
    (r"^\d{4}-\d{2}-\d{2}( CES?T)?$", "%Y-%m-%d", "left(t, 10)"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "%d.%m.%Y", "t"),
    (r"^\d+ [A-Z][a-z]{2} \d{4}$", "%d %b %Y", "t"),
)
_POLISH = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()


def _oracle() -> str:
    polish = "t"
    for i, name in enumerate(_POLISH, 1):
        polish = f"replace({polish}, '{name}', '{i:02d}')"
    wall = "CASE " + " ".join(f"WHEN regexp_matches(t, '{rx}') THEN try_strptime({cut.format(polish=polish)}, '{fmt}')" for rx, fmt, cut in _SHAPES) + " END"
    zone = r"regexp_extract(t, '(?:^\d{8}T\d{6}|\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)(?:-\d{2}:\d{2})?\s*\(?(?:local, )?(Z|GMT|UTC[+-][0-9:]+|UTC|CEST|CET|[+-]\d{2}:?\d{2})', 1)"
    off = r"""CASE WHEN z IN ('Z', 'GMT', 'UTC') THEN 0 WHEN z = 'CET' THEN 60 WHEN z = 'CEST' THEN 120 WHEN z <> '' THEN
  (CASE WHEN contains(z, '-') THEN -1 ELSE 1 END) * (60 * regexp_extract(replace(z, 'UTC', ''), '(\d{1,2}?)(?::?(\d{2}))?$', 1)::INT + coalesce(nullif(regexp_extract(replace(z, 'UTC', ''), '^[+-]\d{1,2}?:?(\d{2})$', 1), '')::INT, 0)) END"""
    return rf"""WITH v AS (SELECT sequence, 'event_time' AS field_name, event_time AS raw FROM journal_observations UNION ALL SELECT sequence, 'recorded_at', recorded_at FROM journal_observations),
 c AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^(?i:timestamp):\s*', ''), '^\[(.*)\]$', '\1') AS t FROM v WHERE NOT regexp_matches(coalesce(raw, ''), '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z$') OR field_name = 'recorded_at'),
 w AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{{10}}$') THEN t::BIGINT * 1000000 WHEN regexp_matches(t, '^\d{{13}}$') THEN t::BIGINT * 1000 END AS counted, {wall} AS wall0, {zone} AS z,
  rpad(left(regexp_extract(t, ':\d{{2}}[.,](\d+)', 1), 6), 6, '0') AS frac, regexp_matches(t, '\d:\d|T\d{{6}}') AS timed FROM c),
 f AS (SELECT *, {off} AS off, wall0 + to_microseconds(CASE WHEN frac = '' OR NOT timed THEN 0 ELSE frac::BIGINT END) AS wall FROM w),
 g AS (SELECT *, wall - INTERVAL 1 HOUR AS late, wall - INTERVAL 2 HOUR AS early FROM f),
 h AS (SELECT *, timezone('Europe/Warsaw', timezone('UTC', late)) = wall AS late_ok, timezone('Europe/Warsaw', timezone('UTC', early)) = wall AS early_ok FROM g),
 fixed AS (SELECT *, coalesce(counted, CASE WHEN off IS NOT NULL THEN epoch_us(wall - to_minutes(off)) END) AS fixed_us FROM h),
 rec AS (SELECT sequence, coalesce(fixed_us, CASE WHEN late_ok OR NOT early_ok THEN epoch_us(late) ELSE epoch_us(early) END) AS rec_us FROM fixed WHERE field_name = 'recorded_at'),
 o AS (SELECT x.*, coalesce(fixed_us, CASE WHEN late_ok AND early_ok THEN CASE WHEN field_name = 'recorded_at' OR rec_us IS NULL OR epoch_us(late) <= rec_us THEN epoch_us(late) ELSE epoch_us(early) END
   WHEN early_ok THEN epoch_us(early) ELSE epoch_us(late) END) AS us FROM fixed x LEFT JOIN rec USING (sequence))
 SELECT sequence, field_name, us AS utc_micros, CASE WHEN counted IS NOT NULL THEN 'exact' WHEN NOT timed THEN 'date_only' WHEN z <> '' OR contains(t, 'Europe/Warsaw') THEN 'exact' ELSE 'local' END AS confidence
 FROM o WHERE us IS NOT NULL AND NOT regexp_matches(raw, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z$')"""


ORACLE = {"p1_found": _oracle()}
QUERIES = {"p1_found": p1_found, "p1_normalised": p1_normalised}
