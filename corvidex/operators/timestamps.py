"""Mixed timestamp texts to one UTC instant.

An ordered cascade of anchored patterns, each with a template that lays the matched
groups out as ``year|month|day|hour|minute|second|fraction|half-day|zone``. The first
pattern that matches wins; its parts are then checked strictly (real calendar date, real
clock time, offset within +-18 h). Everything is a column expression, so the whole
normalisation runs inside the scan stage and moves no rows.

Policies:

* a text that fixes its zone, or a count since 1970, is ``exact``;
* a clock time without zone is read in the row's default zone and is ``local``;
* a date without time of day is its first moment in that zone and is ``date_only``;
* anything else (NULL, empty, placeholders, dates and times that do not exist) has a NULL
  instant and is ``lost``;
* a local time that occurs twice is the later instant that is not after ``not_after``
  (the earlier one if both are after it, the later one if ``not_after`` is NULL);
* a local time that was skipped is read with the offset in force before the change;
* digits beyond microseconds are cut, not rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ZONE = "Europe/Warsaw"

# fixed values: month names and their short forms
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pl_plain": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia wrzesnia pazdziernika listopada grudnia",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "short": "jan feb mar apr may jun jul aug sep oct nov dec",
}
# fixed values: offsets of zone abbreviations, in minutes
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "cet": 60, "cest": 120}

_MONTH_NUMBER = {name: str(i) for names in MONTHS.values() for i, name in enumerate(names.split(), 1)} | {"sept": "9"}

_YMD = r"(\d{4})-(\d{2})-(\d{2})"
_HMS = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_UTC = r"(?:UTC|GMT)\s?[+-]\d{1,2}(?::?\d{2})?"
_ABBR = r"Z|UTC|GMT|UT|CET|CEST"
_NAMED = r"[A-Z][A-Za-z_]+/[A-Z][A-Za-z_]+"
_ZONE = rf"({_OFFSET}|{_UTC}|{_ABBR}|{_NAMED})"
_DAY_NAME = r"[A-Za-z]{3,9}"


@dataclass(frozen=True)
class Pattern:
    """One step of the cascade: ``layout`` orders the groups of ``regex``."""

    name: str
    regex: str
    layout: str


#: Tried in this order. The text has been stripped of a ``Timestamp:`` label and brackets.
CASCADE = (
    Pattern("iso", rf"^{_YMD}[T ]{_HMS}$", "$1|$2|$3|$4|$5|$6|$7||"),
    Pattern("iso_zone", rf"^{_YMD}[T ]{_HMS}\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Pattern("iso_offset_region", rf"^{_YMD}[T ]{_HMS}({_OFFSET}|Z)\[{_NAMED}\]$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Pattern("iso_zone_note", rf"^{_YMD}[T ]{_HMS}\s*\((?:local,\s*)?{_ZONE}\)$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Pattern("range", rf"^{_YMD}[T ](\d{{2}}):(\d{{2}})\s*-\s*\d{{2}}:\d{{2}}$", "$1|$2|$3|$4|$5||||"),
    Pattern("range_zone", rf"^{_YMD}[T ](\d{{2}}):(\d{{2}})\s*-\s*\d{{2}}:\d{{2}}\s*\(?{_ZONE}\)?$", "$1|$2|$3|$4|$5||||$6"),
    Pattern("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}?$", "$1|$2|$3|$4|$5|$6|||$7"),
    Pattern("slashes", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})\s+{_HMS}\s*{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Pattern("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_HMS}\s*{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    Pattern("mail", rf"^{_DAY_NAME},\s*(\d{{1,2}}) (\p{{L}}+) (\d{{4}}) {_HMS}\s*{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    Pattern("clock_tool", rf"^{_DAY_NAME} (\p{{L}}+) +(\d{{1,2}}) {_HMS} {_ZONE} (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    Pattern("clock_tool_local", rf"^{_DAY_NAME} (\p{{L}}+) +(\d{{1,2}}) {_HMS} (\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6||"),
    Pattern("half_day", r"^(\p{L}+)\.? (\d{1,2}), (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp])\.?[Mm]\.?$", "$3|$1|$2|$4|$5|$6||$7|"),
    Pattern("words", rf"^(\d{{1,2}})\.? (\p{{L}}+) (\d{{4}}),?\s+{_HMS}\s*{_ZONE}?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    Pattern("date", rf"^{_YMD}$", "$1|$2|$3||||||"),
    Pattern("date_zone", rf"^{_YMD}\s*\(?{_ZONE}\)?$", "$1|$2|$3||||||$4"),
    Pattern("date_slashes", r"^(\d{4})/(\d{2})/(\d{2})$", "$1|$2|$3||||||"),
    Pattern("date_dots", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3|$2|$1||||||"),
    Pattern("date_words", r"^(\d{1,2})\.? (\p{L}+)\.? (\d{4})$", "$3|$2|$1||||||"),
    Pattern("date_words_us", r"^(\p{L}+)\.? (\d{1,2}), (\d{4})$", "$3|$1|$2||||||"),
    Pattern("date_basic", r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3||||||"),
)
#: Counts since 1970: digits -> microseconds in one unit.
COUNTS = {10: 1_000_000, 13: 1_000, 16: 1, 19: 0}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"

_DAY_US = 86_400_000_000


def _number(part: Column) -> Column:
    return F.when(part != "", part.try_cast("int"))


def _laid_out(text: Column) -> Column:
    """The parts of the first matching pattern, joined by bars; NULL if none matches."""
    out = F.lit(None).cast("string")
    for p in reversed(CASCADE):
        out = F.when(text.rlike(p.regex), F.regexp_replace(text, p.regex, p.layout)).otherwise(out)
    return out


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a fixed zone text (lower case), NULL if it names a region."""
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[zone]
    shape = r"^(?:utc|gmt)?\s?([+-])(\d{1,2}):?(\d{2})?$"
    hours, minutes = (F.regexp_extract(zone, shape, i) for i in (2, 3))
    size = hours.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0))
    size = F.when((minutes == "") | (minutes < "60"), size)
    return F.coalesce(
        abbr, F.when(zone.rlike(shape), F.when(F.regexp_extract(zone, shape, 1) == "-", -size).otherwise(size))
    )


def _instant(us: Column) -> Column:
    return F.timestamp_micros(us)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once.

    A bound lambda variable keeps the optimizer from copying ``value`` to every place that
    uses it, which for a cascade like this one grows beyond any bound when a filter is
    pushed through it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _local_to_utc(wall_us: Column, zone: Column, not_after_us: Column) -> Column:
    """Microseconds of a wall-clock reading in ``zone``, by the policies of this module."""
    early = F.unix_micros(F.to_utc_timestamp(_instant(wall_us), zone))
    # the offset in force a day later; if the reading is valid with it too, it occurs twice
    late = F.unix_micros(F.to_utc_timestamp(_instant(wall_us + _DAY_US), zone)) - _DAY_US

    def choose(e: Column) -> Column:
        def pick(x: Column) -> Column:
            twice = (x > e) & (F.unix_micros(F.from_utc_timestamp(_instant(x), zone)) == wall_us)
            return F.when(twice & F.coalesce(x <= not_after_us, F.lit(True)), x).otherwise(e)

        return let(late, pick)

    return let(early, choose)


def _clean(value: Column) -> Column:
    text = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    text = F.regexp_replace(text, r"^(?i:timestamp)\s*:\s*", "")
    return F.regexp_replace(text, r"^\[([^\[\]]*)\]$", "$1")


def _from_parts(parts: Column, zone: Column, not_after: Column) -> Column:
    """``us`` and ``confidence`` of a laid-out text."""
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    month_name = F.create_map(*[F.lit(x) for kv in _MONTH_NUMBER.items() for x in kv])[F.lower(part(1))]
    year, month, day = _number(part(0)), _number(F.coalesce(month_name, part(1))), _number(part(2))
    date = F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
    date = F.when(parts.isNotNull() & (year > 0), date)
    raw_hour, minute, second = _number(part(3)), _number(part(4)), F.coalesce(_number(part(5)), F.lit(0))
    half = F.lower(part(7))
    hour = F.when(half == "", raw_hour).when(
        (raw_hour >= 1) & (raw_hour <= 12), raw_hour % 12 + F.when(half == "p", 12).otherwise(0)
    )
    timed = part(3) != ""
    time_ok = (hour <= 23) & (minute <= 59) & (second <= 59)
    frac = F.when(part(6) == "", F.lit(0).cast("long")).otherwise(F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long"))
    clock = (hour.cast("long") * 3600 + minute * 60 + second) * 1_000_000 + frac
    wall = F.unix_date(date).cast("long") * _DAY_US + F.when(timed, F.when(time_ok, clock)).otherwise(F.lit(0))
    region = F.when(part(8).isin(*REGIONS), part(8))

    def placed(w: Column) -> Column:
        def shifted(off: Column) -> Column:
            fixed = F.when(off.between(-18 * 60, 18 * 60), w - off.cast("long") * 60_000_000)
            local = _local_to_utc(w, F.when(part(8) == "", zone).otherwise(region), not_after)
            return F.when(off.isNotNull(), fixed).when((part(8) == "") | region.isNotNull(), local)

        return let(_offset_minutes(F.lower(part(8))), shifted)

    confidence = F.when(~timed, "date_only").when(part(8) != "", "exact").otherwise("local")
    return F.struct(let(wall, placed).alias("us"), confidence.alias("confidence"))


def _read(text: Column, zone: Column, not_after: Column) -> Column:
    """Struct of ``us`` and ``confidence`` of a timestamp text."""

    def of(t: Column) -> Column:
        digits = F.when(t.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$|^\d{19}$"), t.try_cast("long"))
        count = F.lit(None).cast("long")
        for n, unit in COUNTS.items():
            scaled = digits * unit if unit else F.floor(digits / F.lit(1000)).cast("long")
            count = F.when(F.length(t) == n, scaled).otherwise(count)
        counted = F.struct(count.alias("us"), F.lit("exact").alias("confidence"))
        laid = let(F.split(_laid_out(t), r"\|"), lambda p: _from_parts(p, zone, not_after))
        return F.when(digits.isNotNull(), counted).otherwise(laid)

    lost = F.struct(F.lit(None).cast("long").alias("us"), F.lit("lost").alias("confidence"))
    return let(let(_clean(text), of), lambda r: F.when(r["us"].isNotNull(), r).otherwise(lost))


def _regions() -> tuple[str, ...]:
    from zoneinfo import available_timezones

    return tuple(sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix/", "right/"))))


#: Region names that a text may give (those of the system's zone tables).
REGIONS = _regions() or (DEFAULT_ZONE,)


def source_zones(sources: DataFrame, key: str, default_zone: str = DEFAULT_ZONE, overrides: DataFrame | None = None) -> DataFrame:
    """``<key>, default_zone`` of every source: what ``overrides`` says of it, else the default.

    ``overrides``: ``<key>, zone``. A NULL zone, or one that the zone tables do not know, is
    no override; of several for one source the smallest counts. Sources come once each.
    """
    out = sources.select(key).distinct()
    if overrides is None:
        return out.withColumn("default_zone", F.lit(default_zone))
    known = overrides.where(F.col("zone").isin(*REGIONS)).groupBy(key).agg(F.min("zone").alias("zone"))
    return out.join(known, key, "left").select(key, F.coalesce("zone", F.lit(default_zone)).alias("default_zone"))


def normalise_timestamps(
    df: DataFrame,
    fields: tuple[str, ...],
    zone_lookup: DataFrame | None = None,
    zone_key: str | None = None,
    default_zone: str = DEFAULT_ZONE,
    not_after: str | None = None,
) -> DataFrame:
    """Adds ``<field>_utc_us`` and ``<field>_confidence`` for each text field.

    ``zone_lookup`` has the columns ``zone_key`` and ``default_zone``; rows without a
    match, a NULL key or a NULL zone use the argument ``default_zone``. Duplicate keys in
    the lookup count once (the smallest zone name). ``not_after`` names the field whose
    instant bounds the later reading of an ambiguous local time; it is normalised first.

    Edge cases: NULL, blank or unreadable texts give NULL and ``lost``; an empty table
    gives an empty table; other columns are kept as they are. Columns whose names begin
    with ``__ts_`` are reserved for the operator while it runs.
    """
    zone = F.lit(default_zone)
    if zone_lookup is not None:
        from corvidex.session import broadcast_if_small

        look = zone_lookup.groupBy(F.col(zone_key).alias("__ts_key")).agg(F.min("default_zone").alias("__ts_zone"))
        df = df.join(broadcast_if_small(look), F.col(zone_key) == F.col("__ts_key"), "left").drop("__ts_key")
        zone = F.coalesce(F.col("__ts_zone"), F.lit(default_zone))
    order = sorted(fields, key=lambda f: f != not_after)
    for f in order:
        bound = F.lit(None).cast("long")
        if not_after is not None and f != not_after and not_after in fields:
            bound = F.col(f"{not_after}_utc_us")
        df = df.withColumn("__ts_read", _read(F.col(f).cast("string"), zone, bound))
        df = df.withColumns({f"{f}_utc_us": F.col("__ts_read.us"), f"{f}_confidence_found": F.col("__ts_read.confidence")}).drop("__ts_read")
    return df.drop("__ts_zone")


def found_timestamps(df: DataFrame, id_column: str, fields: tuple[str, ...]) -> DataFrame:
    """Long form of the readable values that are not canonical yet, one row per value."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field_name"),
                    F.col(f).alias("raw"),
                    F.col(f"{f}_utc_us").alias("utc_micros"),
                    F.col(f"{f}_confidence_found").alias("confidence"),
                )
                for f in fields
            ]
        )
    )
    long = df.select(F.col(id_column), rows.alias("r")).select(id_column, "r.*")
    keep = F.col("utc_micros").isNotNull() & ~F.col("raw").rlike(CANONICAL)
    return long.where(keep).drop("raw")


def to_canonical(us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` of microseconds since 1970 (session zone UTC not needed)."""
    days = F.floor(us / F.lit(_DAY_US)).cast("int")
    rest = us - days.cast("long") * _DAY_US
    ms = F.floor(rest / F.lit(1000)).cast("long")
    return F.format_string(
        "%sT%02d:%02d:%02d.%03dZ",
        F.date_from_unix_date(days).cast("string"),
        F.floor(ms / 3_600_000).cast("long"),
        F.floor(ms / 60_000).cast("long") % 60,
        F.floor(ms / 1000).cast("long") % 60,
        ms % 1000,
    )
