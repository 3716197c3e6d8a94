"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.defects import PairJudge, pair_defects
from corvidex.llm.language import fit_ending_model, fit_language_model
from corvidex.session import load_table


def _judge(spark: SparkSession, sf_dir: str) -> PairJudge:
    docs = load_table(spark, sf_dir, "documents")
    rows = load_table(spark, sf_dir, "journal_observations")
    return PairJudge(fit_language_model(docs, "doc_id", "content", "lang"), fit_ending_model(rows, "assistant_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "journal_observations")
    return pair_defects(rows, "sequence", "user_text", "assistant_text", _judge(spark, sf_dir))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per source."""
    rows = load_table(spark, sf_dir, "journal_observations").select("sequence", "source_identity")
    found = p4_found(spark, sf_dir).join(rows, "sequence")
    return found.groupBy("source_identity", "defect_type").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_summary": p4_summary}
