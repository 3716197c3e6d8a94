"""What is known of a ticket, put together: capsules of its worklog, and active tickets of state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sections of a capsule, in order, and how many bytes it may have
SECTIONS = ("status", "next-action", "blockers", "decisions", "delivery", "findings", "summary")
CAPSULE_BYTES = 8192
# fixed values: life-cycle words of tickets that are done
CLOSED = ("closed", "done", "cancelled", "archived", "delivered")
STATE_SCHEMA = "ticket_key string, lifecycle string, phase string, next_action string, updated_at string, governance_mode string, decisions array<struct<id:string,status:string,description:string>>, blockers array<struct<status:string,description:string>>"


def clipped(text: Column, most: int) -> Column:
    """A text of at most ``most`` bytes: cut at a character, with an ellipsis."""
    fits = F.octet_length(text) <= most
    # the first ``most`` bytes less a cut character: an invalid tail is dropped
    raw = F.encode(text, "UTF-8")
    cut = F.lit("")
    for n in (3, 2, 1, 0):
        part = F.substring(raw, 1, most - 3 - n)
        cut = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(cut)
    return F.when(fits, text).otherwise(F.concat(cut, F.lit("…")))


def capsules(chunks: DataFrame, budget: int = CAPSULE_BYTES) -> DataFrame:
    """``ticket, n_sections, markdown``: the newest section of each category, rendered, within ``budget`` bytes.

    ``chunks``: ``ticket, category, source_path, source_order, start_line, heading, body``. Of
    sections cut from the same lines one counts. A ticket without any of the categories has
    no capsule. The newest is a grouped maximum; what meets per ticket is seven texts.
    """
    rows = chunks.where(F.col("ticket").isNotNull() & F.col("category").isin(*SECTIONS))
    newest = rows.groupBy("ticket", "category").agg(F.max_by(F.struct("source_path", "start_line", "heading", "body"), F.struct("source_path", "source_order")).alias("r"))
    one = newest.groupBy("ticket", "r.source_path", "r.start_line").agg(F.min_by(F.struct("category", "r"), place("category")).alias("x"))
    parts = one.select("ticket", place("x.category").alias("place"), F.concat(F.lit("## "), "x.category", F.lit("\n"), F.coalesce("x.r.body", F.lit(""))).alias("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    out = parts.groupBy("ticket").agg(F.count(F.lit(1)).alias("n_sections"), F.array_join(lines, "\n").alias("body"))
    head = F.concat(F.lit("---\nticket: \""), F.col("ticket"), F.lit("\"\n---\n"))
    return out.select("ticket", "n_sections", clipped(F.concat(head, F.col("body")), budget).alias("markdown"))


def place(category: str) -> Column:
    out = F.lit(len(SECTIONS))
    for i, c in enumerate(SECTIONS):
        out = F.when(F.col(category) == c, i).otherwise(out)
    return out


def ticket_index(chunks: DataFrame) -> DataFrame:
    """``ticket, n_chunks, n_sources, categories``: what the worklogs hold of each ticket."""
    rows = chunks.where("ticket is not null")
    return rows.groupBy("ticket").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("source_path").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


def active_tickets(states: DataFrame, text: str = "text") -> DataFrame:
    """``ticket, phase, next_action, n_blockers, updated_at`` of state files whose ticket is not closed.

    Texts that are no JSON object or name no ticket are left out; of several states of a
    ticket the one updated last counts.
    """
    s = states.select(F.from_json(text, STATE_SCHEMA).alias("s")).where(F.trim("s.ticket_key") != "").select("s.*")
    newest = s.groupBy("ticket_key").agg(F.max_by(F.struct("*"), F.struct(F.coalesce("updated_at", F.lit("")), F.xxhash64("*"))).alias("r")).select("r.*")
    open_ = ~F.coalesce(F.lower("lifecycle").isin(*CLOSED), F.lit(False))
    blocked = F.size(F.filter(F.coalesce("blockers", F.array().cast("array<struct<status:string,description:string>>")), lambda b: ~F.coalesce(F.lower(b["status"]).isin("resolved", "closed"), F.lit(False))))
    return newest.where(open_).select(F.col("ticket_key").alias("ticket"), F.coalesce("phase", "lifecycle").alias("phase"), "next_action", blocked.alias("n_blockers"), "updated_at")
