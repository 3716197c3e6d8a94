"""Writing documents, manifests, logs and reports.

Tables are Parquet, documents partitioned by database and archive. A change to an archive
rewrites that partition only (dynamic partition overwrite).
"""

from __future__ import annotations

import json
import os
import zlib
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

PARTITIONS = ("origin_db", "source")
#: Folder name of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def insert_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def replace_archives(docs: DataFrame, path: str) -> None:
    """Writes the archives that ``docs`` holds, replacing what was there; others stay."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def purge_archive(spark: SparkSession, path: str, source: str, databases: list[str | None]) -> None:
    """Drops an archive's partitions of the given databases (None: rows without one)."""
    from urllib.parse import quote

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for db in databases:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/origin_db={NO_VALUE if db is None else db}/source={quote(source, safe=' ()+,-._')}")
        p.getFileSystem(conf).delete(p, True)


def rename_archive(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Moves an archive's rows to another name: written under the new one first, then dropped under the old."""
    rows = spark.read.parquet(path).where(F.col("source") == old)
    databases = [r.origin_db for r in rows.select("origin_db").distinct().collect()]
    insert_documents(rows.withColumn("source", F.lit(new)), path)
    purge_archive(spark, path, old, databases)


def stage_plan(staged: DataFrame, written: DataFrame) -> DataFrame:
    """``out_path, action``: what a stage writes, leaves or deletes.

    ``staged`` and ``written``: ``out_path, hash`` of the outputs wanted and of those there. An
    output whose hash is not known is written.
    """
    side = lambda x, name: x.select("out_path", F.struct("hash").alias(name))
    j = side(staged, "new").join(side(written, "old"), "out_path", "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("new.hash") == F.col("old.hash"), "keep").otherwise("write")
    return j.select("out_path", action.alias("action"))


def append_text(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Living documents with new chunks: ``origin_db, source, file_path, content``.

    ``chunks``: the same keys, ``chunk_no`` and ``chunk``; chunks of a document are joined in
    order by line feeds to what it holds, or make a new one.
    """
    keys = ["origin_db", "source", "file_path"]
    lines = F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"])
    new = chunks.groupBy(*keys).agg(F.array_join(lines, "\n").alias("added"))
    j = docs.select(*keys, "content").join(new, keys, "full")
    return j.select(*keys, F.concat_ws("\n", "content", "added").alias("content"))


@F.pandas_udf(BinaryType())
def deflate(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else zlib.compress(t.encode("utf-8"), 1))


@F.pandas_udf(StringType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(bytes(b)).decode("utf-8"))


def compression_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    """Bytes before and after compression per archive."""
    sized = docs.select("source", F.octet_length(text).alias("plain"), F.octet_length(deflate(F.col(text))).alias("packed"))
    return sized.groupBy("source").agg(F.count("plain").alias("n"), F.sum("plain").alias("plain_bytes"), F.sum("packed").alias("packed_bytes"))


def emit_turns(entries: DataFrame, known: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """New canonical turns and further sightings of known ones.

    ``entries`` and ``known`` have ``turn_hash``; of several new entries with one hash the
    first in ``order`` (unique) is canonical and the others are sightings, one row each. The
    first is a grouped minimum, so a hash that many entries have is no single task's work.
    """
    hashes = known.select("turn_hash").distinct()
    fresh = entries.join(hashes, "turn_hash", "left_anti")
    first = fresh.groupBy("turn_hash").agg(F.min(F.struct(*order)).alias("__first"))
    marked = entries.join(first, "turn_hash", "left")
    is_first = F.coalesce(F.struct(*order) == F.col("__first"), F.lit(False))
    return marked.where(is_first).drop("__first"), marked.where(~is_first).drop("__first")


def write_hash_index(turns: DataFrame, path: str) -> None:
    """Hash, path, source, lines and sequence as tab-separated text in order of sequence."""
    turns.select("turn_hash", "file_path", "source", "start_line", "end_line", "sequence").orderBy("sequence", "turn_hash").write.mode("overwrite").option("sep", "\t").csv(path)


def export_log(rows: DataFrame, last: int | None = None) -> DataFrame:
    """Journal rows as prompt-log text, one block per row, the last ``last`` of them."""
    if last is not None:
        rows = rows.orderBy(F.col("sequence").desc()).limit(last)
    block = F.concat(
        F.lit("TIMESTAMP: "), F.coalesce("event_time", F.lit("")), F.lit("\nUSER: "), F.coalesce("user_text", F.lit("")), F.lit("\nASSISTANT: "), F.coalesce("assistant_text", F.lit("")), F.lit("\n" + "=" * 80)
    )
    return rows.orderBy("sequence").select("sequence", block.alias("block"))


def save_eval_run(spark: SparkSession, path: str, name: str, config: dict, metrics: DataFrame) -> None:
    """Appends one evaluation run: its configuration and its metric rows as JSON."""
    rows = metrics.select(F.to_json(F.struct("*")).alias("metrics_json"))
    stamped = rows.select(F.lit(name).alias("run"), F.lit(datetime.now(UTC).isoformat()).alias("at"), F.lit(json.dumps(config, sort_keys=True)).alias("config_json"), "metrics_json")
    stamped.write.mode("append").parquet(path)


def analysis_report(files: DataFrame) -> DataFrame:
    """One JSON row: files and bytes per strategy and extension, with totals."""
    per = files.groupingSets([[F.col("strategy"), F.col("extension")], [F.col("strategy")], []], "strategy", "extension").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    return per.select(F.to_json(F.struct("strategy", "extension", "n", "bytes")).alias("line"))


def write_atomic(path: str, text: str) -> None:
    """Driver-side file that is either the old or the new one, never half of it."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
