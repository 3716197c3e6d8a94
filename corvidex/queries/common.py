"""Registering queries with the SQL they must agree with, and SQL pieces several share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvidex.operators import fts
from corvidex.session import ensure_checkpoint_dir, load_table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return add


def sql_tokens(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({expr}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_OPEN: dict[tuple[str, str], fts.Index] = {}


def _stamp(spark: SparkSession, path: str) -> str:
    """Digest of a table's files, their lengths and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    stamp = hashlib.sha256()
    while found.hasNext():
        f = found.next()
        stamp.update(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}\n".encode())
    return stamp.hexdigest()[:32]


def _written(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def text_index(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> fts.Index:
    """The full-text index of ``documents``, written once per state of the table (or anew).

    It lies in the shared folder under the stamp of the table, so a changed table gets a new
    index and every later search reads the written one.
    """
    key = (spark.sparkContext.applicationId, _stamp(spark, f"{sf_dir}/documents.parquet"))
    if rebuild or key not in _OPEN:
        folder = f"{ensure_checkpoint_dir(spark)}/corvidex-index-{key[1]}"
        if rebuild or not _written(spark, f"{folder}/totals"):  # totals are written last
            fts.write_index(fts.index_source(load_table(spark, sf_dir, "documents"), "text", extract=False), folder)
        _OPEN[key] = fts.open_index(spark, folder)
    return _OPEN[key]


def kept_table(spark: SparkSession, sf_dir: str, table: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table derived from another, written once per state of its source."""
    folder = f"{ensure_checkpoint_dir(spark)}/corvidex-{name}-{_stamp(spark, f'{sf_dir}/{table}.parquet')}"
    if not _written(spark, folder):
        make(load_table(spark, sf_dir, table)).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
