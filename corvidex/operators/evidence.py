"""What a conversation turn proves about a ticket, and whether a ticket's state is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.text import strip_front_matter

# fixed values: prompts about retrieval itself, and words of material evidence
RETRIEVAL_META = r"(?is)(?:top[- ]?20|snippet|retriev|worklog\s+(?:comparison|versus)|compar(?:e|ison).*worklog|memory.*stale|fix.*stale)"
MATERIAL = (
    r"(?is)\b(?:deploy(?:ed|ment|ing)?|delivery|rollout|runtime|merged|build(?:\s*#?\d+)?|image\s+\d+(?:-\d+)?|sync(?:ed|hronized)?|healthy|ready|verified|"
    r"block(?:ed|er)|pending|credential|secret|pull request|PR\s*#?\d+|implemented|metric)\b"
)
_USER = r"(?s)## User\s*(.*?)(?:\n## Assistant|\z)"


def user_part(body: Column, whole: bool) -> Column:
    """What stands under the user's heading; without one the whole body, or nothing."""
    text = strip_front_matter(F.coalesce(body, F.lit("")))
    return F.when(text.contains("## User"), F.regexp_extract(text, _USER, 1)).otherwise(text if whole else F.lit(""))


def is_retrieval_meta(body: Column) -> Column:
    """The user asks about retrieval itself; such a turn proves nothing."""
    return user_part(body, whole=True).rlike(RETRIEVAL_META)


def names_ticket(body: Column, ticket: Column) -> Column:
    """The user names the ticket, written as a key or without its dash."""
    key = F.upper(F.trim(ticket))
    said = F.upper(user_part(body, whole=False))
    return F.coalesce((key != "") & (F.contains(said, key) | F.contains(said, F.regexp_replace(key, "[^A-Z0-9]", ""))), F.lit(False))


def is_material(body: Column) -> Column:
    return strip_front_matter(F.coalesce(body, F.lit(""))).rlike(MATERIAL)


def confidence_rank(confidence: Column) -> Column:
    """Times with a zone and local ones count alike, then dates, then the rest."""
    c = F.lower(F.coalesce(confidence, F.lit("")))
    return F.when(c.isin("exact", "local"), 3).when(c.isin("date-only", "date_only"), 2).otherwise(1)


def evidence_order(confidence: str, time: str, sequence: str, path: str) -> list[Column]:
    """Best evidence first: confidence, time (unknown last), sequence, path."""
    return [confidence_rank(F.col(confidence)).desc(), F.coalesce(F.col(time), F.lit(0)).desc(), F.coalesce(F.col(sequence), F.lit(0)).desc(), F.coalesce(F.col(path), F.lit(""))]


def classify(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ticket, freshness, authoritative_through, evidence_through, newer``, one row per ticket.

    ``evidence``: ``ticket, event_us, confidence, body``; ``chunks``: ``ticket, latest_us``.
    Only turns that name the ticket, are material, have a sure time and are not about
    retrieval count. A ticket without a dated chunk is undetermined, one with a later turn
    stale. Groups combine before the shuffle; the only join is on one row per ticket.
    """
    sure = confidence_rank(F.col("confidence")) == 3
    relevant = evidence.where(sure & F.col("event_us").isNotNull() & names_ticket(F.col("body"), F.col("ticket")) & is_material(F.col("body")) & ~is_retrieval_meta(F.col("body")))
    through = chunks.groupBy("ticket").agg(F.max("latest_us").alias("authoritative_through"))
    times = relevant.groupBy("ticket").agg(F.max("event_us").alias("evidence_through"))
    # turns after the state: counted by joining the state to the turns, not the turns to each other
    newer = relevant.join(through, "ticket").where("event_us > authoritative_through").groupBy("ticket").agg(F.count(F.lit(1)).alias("newer"))
    out = through.join(times, "ticket", "full").join(newer, "ticket", "left").withColumn("newer", F.coalesce("newer", F.lit(0)))
    fresh = F.when(F.col("authoritative_through").isNull(), "undetermined").when(F.col("newer") > 0, "stale").otherwise("fresh")
    return out.select("ticket", fresh.alias("freshness"), "authoritative_through", "evidence_through", "newer")
