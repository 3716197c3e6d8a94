from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from corvidex.operators.timestamps import found_timestamps, normalise_timestamps, source_zones, to_canonical

W = ZoneInfo("Europe/Warsaw")


def us(*a, tz=UTC, micro=0):
    return int((datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + micro


CASES = [
    ("2024-02-05T02:57:23.054Z", us(2024, 2, 5, 2, 57, 23, micro=54000), "exact"),
    ("2024-02-06 00:44:31", us(2024, 2, 6, 0, 44, 31, tz=W), "local"),
    ("  Timestamp: 2024-07-05 10:31 ", us(2024, 7, 5, 10, 31, tz=W), "local"),
    ("[2024-02-05 21:37:56 UTC]", us(2024, 2, 5, 21, 37, 56), "exact"),
    ("2024-07-01 12:00 (CET)", us(2024, 7, 1, 11, 0), "exact"),
    ("2024-02-05T12:21:49+01:00[Europe/Warsaw]", us(2024, 2, 5, 11, 21, 49), "exact"),
    ("2024-02-05 18:55:57 Europe/Warsaw", us(2024, 2, 5, 18, 55, 57, tz=W), "exact"),
    ("2024-02-06 12:44-13:14 CET", us(2024, 2, 6, 11, 44), "exact"),
    ("20240205T191417-0500", us(2024, 2, 6, 0, 14, 17), "exact"),
    ("2024-02-11 20:13 UTC+12:45", us(2024, 2, 11, 7, 28), "exact"),
    ("2024-02-06T14:44:28,151+05:30", us(2024, 2, 6, 9, 14, 28, micro=151000), "exact"),
    ("1707203520534", 1707203520534000, "exact"),
    ("1707189946", 1707189946000000, "exact"),
    ("Sep 29, 2024 12:05:52 AM", us(2024, 9, 29, 0, 5, 52, tz=W), "local"),
    ("Wed Oct  9 13:19:31 CEST 2024", us(2024, 10, 9, 11, 19, 31), "exact"),
    ("Fri, 01 Mar 2024 12:38:39 GMT", us(2024, 3, 1, 12, 38, 39), "exact"),
    ("10 października 2024, 01:28", us(2024, 10, 10, 1, 28, tz=W), "local"),
    ("01.03.2024", us(2024, 3, 1, tz=W), "date_only"),
    ("2024-07-06 CEST", us(2024, 7, 5, 22), "date_only"),
    ("2024-02-06T07:16:53.013634987Z", us(2024, 2, 6, 7, 16, 53, micro=13634), "exact"),
    ("2024-03-31 02:30", us(2024, 3, 31, 1, 30), "local"),  # skipped: old offset +1
    ("2024-10-27 02:30", us(2024, 10, 27, 1, 30), "local"),  # twice, no bound: later
    *[(x, None, "lost") for x in ("24:70", "2026-02-30 10:00", "2025-13-04T09:00:00Z", "0000-00-00 00:00:00", "", "TODO", None, "2024-02-05 25:00", "2024-02-05T10:00:00+19:00", "x" * 200_000)],
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t, None) for i, (t, _, _) in enumerate(CASES)], "id int, at string, source string")
    rows = {r.id: r for r in normalise_timestamps(df, ("at",)).collect()}
    for i, (text, want, conf) in enumerate(CASES):
        assert (rows[i].at_utc_us, rows[i].at_confidence_found) == (want, conf), text


@pytest.mark.parametrize(
    "recorded,want", [("2024-10-27T00:40:00.000Z", us(2024, 10, 27, 0, 30)), ("2024-10-27T01:40:00.000Z", us(2024, 10, 27, 1, 30)), ("2024-10-26T00:00:00.000Z", us(2024, 10, 27, 0, 30)), ("TODO", us(2024, 10, 27, 1, 30))]
)
def test_ambiguous_is_bounded(spark, recorded, want):
    df = spark.createDataFrame([("2024-10-27 02:30", recorded)], "event_time string, recorded_at string")
    out = normalise_timestamps(df, ("event_time", "recorded_at"), not_after="recorded_at").first()
    assert out.event_time_utc_us == want


def test_zone_lookup_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "2024-07-01 00:00", 1), ("b", "2024-07-01 00:00", 2), (None, "2024-07-01", 3)], "src string, at string, default_zone int")
    zones = spark.createDataFrame([("a", "Asia/Tokyo"), ("a", "Asia/Tokyo"), ("b", None)], "src string, default_zone string")
    out = {r.default_zone: r.at_utc_us for r in normalise_timestamps(df, ("at",), zones, "src").collect()}
    assert out == {1: us(2024, 6, 30, 15), 2: us(2024, 6, 30, 22), 3: us(2024, 6, 30, 22)}


def test_found_and_canonical(spark):
    df = spark.createDataFrame([(1, "2024-02-05T02:57:23.054Z", "2024-02-05"), (2, None, "bad")], "id long, a string, b string")
    n = normalise_timestamps(df, ("a", "b"))
    assert [tuple(r) for r in found_timestamps(n, "id", ("a", "b")).collect()] == [(1, "b", us(2024, 2, 4, 23), "date_only")]
    assert n.where("id = 1").select(to_canonical(F.col("a_utc_us"))).first()[0] == "2024-02-05T02:57:23.054Z"
    assert normalise_timestamps(df.limit(0), ("a",)).count() == 0


def test_zone_of_each_source(spark):
    src = spark.createDataFrame([("ny",), ("tokyo",), ("odd",), ("none",), ("ny",), (None,)], "src string")
    over = spark.createDataFrame([("ny", "America/New_York"), ("tokyo", "Asia/Tokyo"), ("tokyo", "Europe/Paris"), ("odd", "Mars/Base"), ("none", None)], "src string, zone string")
    zones = source_zones(src, "src", overrides=over)
    assert {r.src: r.default_zone for r in zones.collect()} == {"ny": "America/New_York", "tokyo": "Asia/Tokyo", "odd": "Europe/Warsaw", "none": "Europe/Warsaw", None: "Europe/Warsaw"}
    # each side of both changes of New York: the repeated hour takes the later instant, the skipped one the old offset
    at = ["2024-11-03 00:59", "2024-11-03 01:30", "2024-11-03 02:00", "2024-03-10 01:59", "2024-03-10 02:30", "2024-03-10 03:00"]
    want = [us(2024, 11, 3, 4, 59), us(2024, 11, 3, 6, 30), us(2024, 11, 3, 7, 0), us(2024, 3, 10, 6, 59), us(2024, 3, 10, 7, 30), us(2024, 3, 10, 7, 0)]
    df = spark.createDataFrame([(i, "ny", t) for i, t in enumerate(at)], "id int, src string, at string")
    got = {r.id: r.at_utc_us for r in normalise_timestamps(df, ("at",), zones, "src").collect()}
    assert [got[i] for i in range(len(at))] == want
