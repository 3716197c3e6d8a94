"""Filters over documents and journal rows. Each returns a DataFrame; all are column predicates
that reach the scan, orderings end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.text import contains_ci, like

# fixed values: archives that are searchable, by database
SEARCHABLE_DATABASES = ("convo.db", "artifacts.db", "dross.db", "worklogs.db", "memory.db")
# fixed values: rank of authorities and of worklog categories for ordering
AUTHORITY_ARCHIVES = ("worklog:state", "worklog:chunks")


def path_like(docs: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Paths like ``pattern`` (wrapped in ``%`` if it has no wildcard), without regard to case."""
    p = pattern if "%" in pattern or "_" in pattern else f"%{pattern}%"
    out = docs.where(like(F.col("file_path"), p))
    return out.orderBy("file_path", "doc_id").limit(limit) if limit is not None else out


def clean_extension(ext: str) -> str:
    """``none`` and ``noext`` mean no extension; a dot is put in front."""
    e = ext.strip().lower()
    if e in ("none", "noext", ""):
        return ""
    return e if e.startswith(".") else f".{e}"


def extension_eq(docs: DataFrame, ext: str) -> DataFrame:
    e = clean_extension(ext)
    # a plain equality can be pushed to the scan; only "none" must look at NULLs
    return docs.where(F.col("extension") == e) if e else docs.where(F.coalesce(F.col("extension"), F.lit("")) == "")


def extension_in(docs: DataFrame, exts: list[str]) -> DataFrame:
    return docs.where(F.lower(F.coalesce("extension", F.lit(""))).isin(*{clean_extension(e) for e in exts}))


def archive(docs: DataFrame, name: str, column: str = "source") -> DataFrame:
    """The archive ``name``, or archives whose name contains it."""
    return docs.where((F.col(column) == name) | contains_ci(F.col(column), name))


def facet(docs: DataFrame, ticket: str | None = None, mode: str | None = None, impact: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Path facets ``turns/<ticket>/d<yyyymmdd>/<mode>/impact-<x>/...``, dates inclusive."""
    f = facet_columns()
    cond = F.lit(True)
    for name, value in (("ticket", ticket), ("mode", mode), ("impact", impact)):
        if value is not None:
            cond = cond & (f[name] == value)
    if since is not None:
        cond = cond & (f["date"] >= since)
    if until is not None:
        cond = cond & (f["date"] <= until)
    return docs.where(cond)


def facet_columns(path: str = "file_path") -> dict[str, Column]:
    """Facets of a turn path as columns; '' where a path has none."""
    rx = r"^turns/([^/]*)/d(\d{8})/([^/]*)/impact-([^/]*)/turn-0*(\d+)\.md$"
    names = ("ticket", "date", "mode", "impact")
    out = {n: F.regexp_extract(path, rx, i) for i, n in enumerate(names, 1)}
    out["sequence"] = F.regexp_extract(path, rx, 5).try_cast("long")
    return out


def recent_turns(docs: DataFrame, n: int) -> DataFrame:
    """Newest turns by the number in their file name."""
    turns = docs.where(F.col("file_name").rlike(r"^turn-[0-9].*\.md$"))
    seq = F.regexp_extract("file_name", r"^turn-0*(\d+)", 1).try_cast("long")
    return turns.withColumn("sequence", seq).orderBy(F.col("sequence").desc_nulls_last(), "origin_db", "file_path", F.col("doc_id").desc()).limit(n)


def scope(docs: DataFrame, databases: list[str] | None, members: DataFrame | None = None) -> DataFrame:
    """Rows of named databases, or of the databases a dataset lists; others are not searched."""
    out = docs.where(F.col("origin_db").isin(*SEARCHABLE_DATABASES))
    if databases:
        out = out.where(F.col("origin_db").isin(*databases))
    if members is not None:
        out = out.join(members.select("origin_db").distinct(), "origin_db", "left_semi")
    return out


def literal(rows: DataFrame, columns: list[str], needle: str, order: str, limit: int) -> DataFrame:
    """Rows with ``needle`` in any column; wildcards in it have no meaning."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(contains_ci(F.col(c), needle), F.lit(False))
    return rows.where(cond).orderBy(order).limit(limit)


def regex(rows: DataFrame, columns: list[str], pattern: str, order: str, limit: int) -> DataFrame:
    """Rows whose columns, joined by line feeds, match a pattern."""
    return rows.where(F.concat_ws("\n", *columns).rlike(pattern)).orderBy(order).limit(limit)


def sequence_range(rows: DataFrame, a: int, b: int, column: str = "sequence") -> DataFrame:
    return rows.where(F.col(column).between(min(a, b), max(a, b)))


def tail(rows: DataFrame, n: int, column: str = "sequence") -> DataFrame:
    """Last ``n`` rows, in ascending order."""
    return rows.orderBy(F.col(column).desc()).limit(n).orderBy(column)


def after_sequence(rows: DataFrame, n: int, column: str = "sequence") -> DataFrame:
    return rows.where(F.col(column) > n)


def by_key(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows of one prompt, session or source; the plain equality reaches the scan. NULL finds nothing."""
    return rows.where(F.col(column) == F.lit(value)) if value is not None else rows.limit(0)
