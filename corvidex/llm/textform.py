"""One consistent form for texts that look alike (problem 8).

An Arrow column's UTF-8 bytes become one numpy code-point array per batch. A lookup table
gives every code point its expansion (offset and length in a pool); the expansions are
gathered at once, marks are put in canonical order and composed with vector operations,
and the result goes back into Arrow buffers. No string call is made per row.

What the table does, by rule from the Unicode data of Python:

* invisible characters (format characters, variation selectors, soft hyphen) vanish;
* every kind of space is a plain space, every kind of line end one line feed;
* hyphens are hyphen-minus; dashes stay, they are longer;
* canonical decompositions are followed, and those compatibility decompositions that do
  not change the look: width, no-break, joined and positional forms;
* raised and lowered digits, fractions, circled and styled letters stay;
* look-alike letters of Greek and Cyrillic become the Latin letter.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: letters that look the same
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ"
LOOKALIKE_TO = "ABESIJKMHOPCTYXaeopcyxsijhdqwABEZHIKMNOPTYXovj"
# fixed values: hyphens of the length of hyphen-minus, and line ends
HYPHENS = {0x2010, 0x2011, 0x2043, 0xFE63, 0xFF0D}
LINE_ENDS = {0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
# fixed values: format characters that are drawn
DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# fixed values: invisible characters that are not of the format category
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}

_SIZE = 0x110000
_RANGES = ((0, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    look = dict(zip(map(ord, LOOKALIKE_FROM), map(ord, LOOKALIKE_TO), strict=True))

    def expand(cp: int) -> tuple[int, ...]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cp in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or (cat == "Cf" and cp not in DRAWN_FORMATS):
            return ()
        if cp in LINE_ENDS:
            return (10,)
        if cat == "Zs":
            return (32,)
        if cp in HYPHENS:
            return (45,)
        parts = unicodedata.decomposition(ch).split()
        if parts:
            tag = parts.pop(0) if parts[0].startswith("<") else ""
            to = [int(x, 16) for x in parts]
            letters = all(unicodedata.category(chr(x))[0] in "LM" for x in to)
            joined = tag == "<compat>" and (cp == 0xB5 or cp == 0x2026 or (len(to) > 1 and letters))
            if not tag or tag in SAME_LOOK_TAGS or joined:
                return tuple(y for x in to for y in expand(x))
        return (look.get(cp, cp),)

    start = np.arange(_SIZE, dtype=np.int32)
    length = np.ones(_SIZE, dtype=np.int8)
    ccc = np.zeros(_SIZE, dtype=np.uint8)
    extra: list[int] = []
    pairs: dict[int, int] = {}
    for lo, hi in _RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            ccc[cp] = unicodedata.combining(ch)
            to = expand(cp)
            if to != (cp,):
                start[cp], length[cp] = _SIZE + len(extra), len(to)
                extra.extend(to)
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in d.split())
                pairs[look.get(a, a) << 21 | b] = cp if look.get(a, a) == a else pairs.get(look.get(a, a) << 21 | b, cp)
    # a pair whose base is a look-alike must give the letter that the Latin base gives
    for key in list(pairs):
        a, b = key >> 21, key & 0x1FFFFF
        made = unicodedata.normalize("NFC", chr(a) + chr(b))
        if len(made) == 1:
            pairs[key] = ord(made)
        else:
            del pairs[key]
    keys = np.array(sorted(pairs), dtype=np.int64)
    second = np.zeros(_SIZE, dtype=bool)
    second[keys & 0x1FFFFF] = True
    pool = np.concatenate([np.arange(_SIZE, dtype=np.uint32), np.array(extra, dtype=np.uint32)])
    return {
        "start": start, "length": length, "pool": pool, "ccc": ccc, "joins": second | (ccc > 0),
        "keys": keys, "made": np.array([pairs[int(k)] for k in keys], dtype=np.uint32),
    }


def _compose(cps: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition; returns the new code points and which to keep."""
    t = _tables()
    keep = np.ones(len(cps), dtype=bool)
    joins = t["joins"][cps]
    if not joins.any():
        return cps, keep
    ccc = t["ccc"][cps]
    at = np.flatnonzero(ccc)
    if len(at) > 1:
        run = np.cumsum(np.r_[True, (np.diff(at) != 1) | row_start[at[1:]]])
        order = np.lexsort((at, ccc[at], run))
        cps[at], ccc[at] = cps[at][order], ccc[at][order]
        joins = t["joins"][cps]
    idx = np.arange(len(cps))
    base_of = np.maximum.accumulate(np.where(~joins | row_start, idx, -1))
    marks = np.flatnonzero(joins & ~row_start & (base_of >= 0))
    if not len(marks):
        return cps, keep
    base, count = np.unique(base_of[marks], return_counts=True)
    now, last = cps[base].astype(np.int64), np.full(len(base), -1, dtype=np.int16)
    live, k = np.arange(len(base)), 0
    while len(live := live[count[live] > k]):
        p = base[live] + 1 + k
        c = ccc[p].astype(np.int16)
        key = now[live] << 21 | cps[p]
        i = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        free = np.where(c == 0, last[live] == -1, (last[live] < c) & (last[live] != 0))
        hit = (t["keys"][i] == key) & free
        now[live[hit]] = t["made"][i[hit]]
        keep[p[hit]] = False
        last[live[~hit]] = c[~hit]
        k += 1
    cps[base] = now
    return cps, keep


def _code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and each row's offset (NULL rows are empty)."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    text = raw.tobytes().decode("utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, seen[off - off[0]]


def _rebuilt(cps: np.ndarray, off: np.ndarray, valid: pa.Array) -> pa.Array:
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[off].astype(np.int64)
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))
    return pa.compute.if_else(valid, out, pa.scalar(None, pa.large_string())) if valid is not None else out


def unify_array(arr: pa.Array) -> pa.Array:
    """The consistent form of every string of an Arrow array; NULL stays NULL."""
    import pyarrow.compute as pc

    if not len(arr):
        return arr.cast(pa.large_string())
    t = _tables()
    try:
        cps, off = _code_points(arr)
    except UnicodeDecodeError:  # bytes that are no UTF-8: U+FFFD takes their place
        arr = pa.array([None if b is None else b.decode("utf-8", "replace") for b in arr.cast(pa.large_binary()).to_pylist()], pa.large_string())
        cps, off = _code_points(arr)
    length = t["length"][cps].astype(np.int64)
    pair = np.flatnonzero((cps[:-1] == 13) & (cps[1:] == 10))
    length[pair[~np.isin(pair + 1, off)]] = 0  # CR LF inside one row
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    out = t["pool"][np.repeat(t["start"][cps] - (ends - length), length) + np.arange(total)]
    off = np.concatenate([[0], ends])[off]
    row_start = np.zeros(total + 1, dtype=bool)
    row_start[off] = True
    out, keep = _compose(out, row_start[:total])
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    return _rebuilt(out[keep], off, pc.is_valid(arr) if arr.null_count else None)


def unify_text(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """Adds ``out``: the form of ``column`` in which texts that look alike are equal.

    NULL stays NULL, the empty text stays empty, a text of invisible characters becomes
    empty. Whole texts are read; white space is kept as it lies (no trimming or folding
    of runs). If ``out`` exists it is replaced. Runs in the scan stage, without a shuffle.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*kept, StructField(out, StringType())])

    def run(batches):
        for b in batches:
            for part in _small(b, column):
                form = unify_array(part.column(part.schema.get_field_index(column))).cast(pa.string())
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, form], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


#: Bytes of text handled at once: forms may be a few times longer and must fit 32-bit offsets.
BATCH_BYTES = 256 << 20


def _small(b: pa.RecordBatch, column: str) -> list[pa.RecordBatch]:
    """A batch in parts of at most ``BATCH_BYTES`` of text (or one row)."""
    if b.num_rows < 2 or b.column(b.schema.get_field_index(column)).nbytes <= BATCH_BYTES:
        return [b]
    half = b.num_rows // 2
    return _small(b.slice(0, half), column) + _small(b.slice(half), column)


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


#: Parts into which the members of a form are spread, so that a form that holds a large part of
#: all rows is no single task's work.
SALTS = 16


def _members(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, f, t`` and, per form ``f`` with more than one stored text ``t``: the smallest id, rows and variants."""
    from corvidex.session import cut_lineage

    rows = df.where(F.length(column) > 0).select(F.col(id_column).alias("id"), F.col(column).alias("t"))
    keyed = cut_lineage(unify_text(rows, "t", "f").select("id", _digest(F.col("f")).alias("f"), _digest(F.col("t")).alias("t")))
    variants = keyed.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    forms = variants.groupBy("f").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"), F.min("first").alias("class_id")).where("variants > 1")
    salted = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["f", "salt"]).drop("salt")


def look_alike_classes(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """One row per row whose text has a look-alike: ``<id>, class_id, variant_id, n_links``.

    A class is a form that more than one stored text has, named by its smallest id; a variant
    is one of these texts, named by the smallest id of its copies. ``n_links`` counts the rows
    of the class with another stored text. The size follows the rows, not their pairs. Rows
    with NULL or empty text and rows without a look-alike are left out.
    """
    members = _members(df, id_column, column)
    own = members.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("variant_id"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(own, ["f", "t", "salt"])
    return j.select(F.col("id").alias(id_column), "class_id", "variant_id", (F.col("rows") - F.col("n")).alias("n_links"))


def look_alike_pairs(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """Pairs of rows whose texts differ as stored but have the same form.

    Columns ``<id>_a`` < ``<id>_b``. Rows with NULL or empty text take no part. Only
    128-bit digests of form and text are moved. Texts are joined variant against variant
    (a variant is a distinct stored text of one form), so a group of exact copies, however
    large, adds no work unless it has a look-alike; then every pair is a result row. Where
    that is too much, ``look_alike_classes`` says the same with one row per text.
    """
    from corvidex.session import cut_lineage

    members = cut_lineage(_members(df, id_column, column).select("f", "t", "id"))
    distinct = members.select("f", "t").distinct()
    a, b = distinct.select("f", F.col("t").alias("ta")), distinct.select("f", F.col("t").alias("tb"))
    meets = a.join(b, "f").where(F.col("ta") < F.col("tb"))
    left = members.select("f", F.col("t").alias("ta"), F.col("id").alias("x"))
    right = members.select("f", F.col("t").alias("tb"), F.col("id").alias("y"))
    pairs = meets.join(left, ["f", "ta"]).join(right, ["f", "tb"])
    return pairs.select(F.least("x", "y").alias(f"{id_column}_a"), F.greatest("x", "y").alias(f"{id_column}_b"))
