"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.mixing import mix_sources
from corvidex.llm.packing import pack
from corvidex.llm.tokens import token_counts
from corvidex.session import cut_lineage, load_table


def _containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = load_table(spark, sf_dir, "container_sizes").orderBy("capacity_tokens", "container_name").collect()
    return [(r.container_name, r.capacity_tokens) for r in rows]


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in containers of each capacity."""
    sizes = token_counts(load_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return pack(sizes, "doc_id", _containers(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    caps = load_table(spark, sf_dir, "container_sizes")
    bins = p6_containers(spark, sf_dir).groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("used"))
    per = bins.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("used_tokens"))
    room = F.col("n_bins") * F.col("capacity_tokens")
    return per.join(caps, "container_name").select(
        "container_name", "capacity_tokens", "n_bins", "used_tokens", (1 - F.col("used_tokens") / room).alias("unused_share")
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(token_counts(load_table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"))


def p7_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes, block by block."""
    return mix_sources(_sizes(spark, sf_dir), load_table(spark, sf_dir, "mix_targets"), "doc_id", "source", all_reach=False)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every source of every mix."""
    return mix_sources(_sizes(spark, sf_dir), load_table(spark, sf_dir, "mix_targets"), "doc_id", "source", all_reach=False)[1]


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: per container kind the texts packed, and faults of each sort."""
    docs = token_counts(load_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    sizes = cut_lineage(docs)
    caps = _containers(spark, sf_dir)
    rows = pack(sizes, "doc_id", caps).join(load_table(spark, sf_dir, "container_sizes"), "container_name")
    fill = rows.groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity_tokens").alias("cap"))
    over = fill.groupBy("container_name").agg(F.count_if(F.col("used") > F.col("cap")).alias("over_full"))
    per = rows.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.max("capacity_tokens").alias("cap"))
    per = per.join(sizes.withColumnRenamed("n_tokens", "size"), "doc_id")
    told = per.groupBy("container_name").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("got") != F.col("size")).alias("lost_tokens"), F.count_if(F.col("pieces") != F.ceil(F.col("size") / F.col("cap"))).alias("cut_needlessly")
    )
    return told.join(over, "container_name").select("container_name", "n_texts", "lost_tokens", "cut_needlessly", "over_full")


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mix: sources listed, texts used too often, blocks used twice in a pass, shares adding up."""
    targets = load_table(spark, sf_dir, "mix_targets")
    mixed, report = mix_sources(_sizes(spark, sf_dir), targets, "doc_id", "source", all_reach=False)
    caps = targets.groupBy("mix_name", "source").agg(F.min("max_repeats").alias("cap"))
    uses = mixed.groupBy("mix_name", "source", "doc_id", "token_start").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repeat_no").alias("passes"))
    uses = uses.join(caps, ["mix_name", "source"]).groupBy("mix_name").agg(F.count_if(F.col("n") > F.col("cap")).alias("used_too_often"), F.count_if(F.col("n") != F.col("passes")).alias("twice_in_a_pass"))
    told = report.groupBy("mix_name").agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.sum("actual_share"), 6).alias("share_sum"))
    return told.join(uses, "mix_name", "left").select("mix_name", "n_sources", "share_sum", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used_too_often", "twice_in_a_pass")])


ORACLE = {
    "p6_audit": "SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_texts, 0 AS lost_tokens, 0 AS cut_needlessly, 0 AS over_full FROM container_sizes",
    "p7_audit": "SELECT mix_name, count(DISTINCT source) AS n_sources, 1.0::DOUBLE AS share_sum, 0 AS used_too_often, 0 AS twice_in_a_pass FROM mix_targets GROUP BY 1",
}
QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_audit": p6_audit, "p7_mixes": p7_mixes, "p7_shares": p7_shares, "p7_audit": p7_audit}
