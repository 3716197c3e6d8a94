"""Transcripts in JSON lines to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: record types that carry no message
CONTROL_TYPES = (
    "attachment", "queue-operation", "atis-latch", "last-prompt", "system", "file-history-snapshot", "file-history-delta", "ai-title", "mode",
    "permission-mode", "cost-state", "custom-title", "agent-name", "api-request-shape", "api-request", "api-request-blob", "tools-used", "continued-in",
)


class UnknownFormatError(ValueError):
    pass


def read_lines(spark, path: str) -> DataFrame:
    """``path, line_no, line`` of JSON-lines files; line numbers come with the text of a file."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _parts(record: Column, kinds: tuple[str, ...]) -> Column:
    content = F.get_json_object(record, "$.message.content")
    arr = F.from_json(F.when(F.startswith(F.ltrim(content), F.lit("[")), content), "array<struct<type:string,text:string,content:string>>")
    texts = F.transform(F.filter(arr, lambda p: p["type"].isin(*kinds)), lambda p: F.coalesce(F.when(p["type"] == "text", p["text"]).otherwise(p["content"]), F.lit("")))
    return F.trim(F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), content, F.lit("")))


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``kind``: user, assistant, control, blank, broken (no JSON object), unknown."""
    t = F.get_json_object("line", "$.type")
    role = F.get_json_object("line", "$.role")
    is_object = F.startswith(F.ltrim("line"), F.lit("{")) & F.try_parse_json("line").isNotNull()
    kind = (
        F.when(F.trim("line") == "", "blank")
        .when(~is_object, "broken")
        .when(t.isin(*CONTROL_TYPES), "control")
        .when(t.isin("user", "assistant"), t)
        .when(t.isNull() & role.isin("user", "assistant"), role)
        .otherwise("unknown")
    )
    return lines.withColumn("kind", kind)


def turns(lines: DataFrame, fail_on_unknown: bool = True) -> DataFrame:
    """``path, turn, start_line, prompt_id, session_id, event_time, user_text, assistant_text``.

    A user record starts a turn, the assistant texts after it are joined; a turn without a
    reply is held back for the next read. Files with records of an unknown format are
    refused as a whole (or left out, if ``fail_on_unknown`` is false).
    """
    known = classify(lines)
    strange = known.where("kind = 'unknown'").select("path").distinct()
    if fail_on_unknown:
        first = strange.limit(1).collect()
        if first:
            raise UnknownFormatError(f"unknown record format in {first[0].path}")
    talk = known.where("kind in ('user', 'assistant')").join(strange, "path", "left_anti")
    field = lambda *names: F.coalesce(*[F.get_json_object("line", f"$.{n}") for n in names])
    said = F.when(F.col("kind") == "user", _parts(F.col("line"), ("text", "tool_result"))).otherwise(_parts(F.col("line"), ("text",)))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = talk.select("path", "line_no", "kind", said.alias("said"), field("promptId", "promptid").alias("prompt_id"), field("sessionId", "sessionid").alias("session_id"), field("timestamp").alias("at"))
    rows = rows.withColumn("turn", F.sum((F.col("kind") == "user").cast("int")).over(w)).where("turn > 0")
    reply = F.when((F.col("kind") == "assistant") & (F.col("said") != ""), F.struct("line_no", "said"))
    out = rows.groupBy("path", "turn").agg(
        F.min("line_no").alias("start_line"), F.min_by("prompt_id", "line_no").alias("prompt_id"), F.min_by("session_id", "line_no").alias("session_id"),
        F.min_by("at", "line_no").alias("event_time"), _clean_user(F.min_by("said", "line_no")).alias("user_text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(reply)), lambda x: x["said"]), "\n").alias("assistant_text"),
    )
    return out.where("assistant_text <> ''")


def _clean_user(c: Column) -> Column:
    """User text without the wrappers that some clients put around it."""
    c = F.regexp_replace(c, r"(?s)<timestamp>.*?</timestamp>\s*", "")
    return F.trim(F.regexp_replace(c, r"(?s)</?user_query>", ""))
