"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.textform import look_alike_classes, look_alike_pairs, unify_text
from corvidex.session import load_table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(load_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alike texts by class, with the number of links of each."""
    return look_alike_classes(load_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form, and whether that changed it."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = unify_text(docs, "text", "form")
    return out.select("doc_id", "form", (F.col("form") != F.col("text")).alias("changed"))


QUERIES = {"p8_found": p8_found, "p8_classes": p8_classes, "p8_unified": p8_unified}
