"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.conversations import message_text, rebuild_conversations
from corvidex.session import load_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(load_table(spark, sf_dir, "claude_turn"))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations with their texts."""
    records = load_table(spark, sf_dir, "claude_turn")
    order = rebuild_conversations(records)
    texts = records.where("uuid is not null").select("uuid", "record_no", message_text(F.col("message.content")).alias("text"))
    texts = texts.join(order.select("uuid"), "uuid", "left_semi").groupBy("uuid").agg(F.min_by("text", "record_no").alias("text"))
    return order.join(texts, "uuid").select("sessionid", "turn_no", "speaker", "uuid", "text")


QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations}
