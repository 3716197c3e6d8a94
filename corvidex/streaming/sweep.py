"""One sweep over a store: from new journal rows to a searchable, checked state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.operators import fts, tickets
from corvidex.operators import journal as JR
from corvidex.sources import sinks, worklog

#: Steps in their order; each reads what the one before wrote.
STEPS = ("reconcile", "project", "sync", "worklogs", "digests", "index", "integrity")


def sweep(spark: SparkSession, canonical: DataFrame, journal: DataFrame, worklogs: DataFrame, store: str, cursor: int = 0) -> DataFrame:
    """``step, n``: what each step of a sweep produced, written below ``store``.

    ``canonical``: canonical journal rows (``sequence, user_text, assistant_text, tier``);
    ``journal``: all rows, for the check of the chain; ``worklogs``: ``path, text``. Every step
    is a job of its own that writes its result, so a sweep that broke off is repeated from
    the start without harm: archives are replaced, not appended to.
    """
    done: list[tuple[str, int]] = [("reconcile", canonical.count())]
    JR.project(canonical, cursor).write.mode("overwrite").parquet(f"{store}/projected")
    projected = spark.read.parquet(f"{store}/projected")
    done.append(("project", projected.count()))

    docs = projected.select(
        F.col("sequence").alias("doc_id"), F.when(F.col("tier") == "turns", "convo.db").otherwise("artifacts.db").alias("origin_db"), F.concat(F.lit("chat:"), "tier").alias("source"),
        F.concat(F.lit("swept/"), "file_name").alias("file_path"), "file_name", F.col("text").alias("content"),
    )
    sinks.replace_archives(docs, f"{store}/documents")
    done.append(("sync", spark.read.parquet(f"{store}/documents").count()))

    worklog.parse_worklogs(worklogs).write.mode("overwrite").parquet(f"{store}/chunks")
    chunks = spark.read.parquet(f"{store}/chunks")
    done.append(("worklogs", chunks.select("source_path").distinct().count()))
    tickets.capsules(chunks).write.mode("overwrite").parquet(f"{store}/capsules")
    done.append(("digests", spark.read.parquet(f"{store}/capsules").count()))

    fts.write_index(fts.index_source(spark.read.parquet(f"{store}/documents")), f"{store}/index")
    indexed = fts.open_index(spark, f"{store}/index")
    done.append(("index", indexed.totals.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]))
    report = JR.chain_report(journal, ["sequence", "observation_id"]).first()
    done.append(("integrity", report.gaps + report.broken))
    return spark.createDataFrame(done, "step string, n long")
