"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.pii import Detector
from corvidex.llm.surrogates import find_mentions, redact, text_rows, with_names
from corvidex.session import load_table

#: Largest directory of names that is carried to the tasks; of a larger one each text gets the names it needs.
MAX_DIRECTORY = 200_000
#: Key of the surrogates of these queries; a deployment gives its own secret.
QUERY_KEY = b"corvidex-demo-key"


def directory(contacts: DataFrame) -> Detector | None:
    """A detector from a table of people, None if it is too large to be carried."""
    rows = contacts.select("given_name", "family_name").distinct().limit(MAX_DIRECTORY + 1).collect()
    if len(rows) > MAX_DIRECTORY:
        return None
    return Detector(sorted({r[0] for r in rows if r[0]}), sorted({r[1] for r in rows if r[1]}))


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Detector | None]:
    contacts = load_table(spark, sf_dir, "contacts")
    texts, detector = _texts(spark, sf_dir), directory(contacts)
    return (texts if detector else with_names(texts, contacts)), detector


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = text_rows(load_table(spark, sf_dir, "journal_observations"), "journal_observations", "sequence", ("user_text", "assistant_text"))
    return journal.unionByName(text_rows(load_table(spark, sf_dir, "documents"), "documents", "doc_id", ("content",)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that get a surrogate; each row comes with the one it gets, which is left out here."""
    found = find_mentions(*_searched(spark, sf_dir), QUERY_KEY)
    return found.drop("surrogate")


def p2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mentions and how many different surrogates each type has."""
    found = find_mentions(*_searched(spark, sf_dir), QUERY_KEY)
    per = found.groupBy("pii_type", "surrogate").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("pii_type").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_surrogates"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal details replaced by typed surrogates."""
    return redact(*_searched(spark, sf_dir), QUERY_KEY)


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p2_surrogates": p2_surrogates}
