"""The journal as a stream: reading, exactly-once recording, projection, windows, turn tails."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a transcript may be.
LAG = "5 minutes"


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New files of a folder; which were read is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def read_text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files dropped into a folder (the form of text appended from outside)."""
    return spark.readStream.text(path).withColumn("path", F.input_file_name())


def record_stream(events: DataFrame, key: str = "idempotency_key", at: str = "event_time", lag: str = LAG) -> DataFrame:
    """Each key once within the watermark; state of older keys is dropped."""
    return events.withWatermark(at, lag).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, width: str, group: list[str], slide: str | None = None, lag: str = LAG) -> DataFrame:
    """Tumbling (or sliding) event-time windows; an extension beyond the incremental batches."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, lag).groupBy(w.alias("w"), *group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, "n")


def sessions(events: DataFrame, at: str, gap: str, group: list[str], lag: str = LAG) -> DataFrame:
    """Sessions per group that end after a pause of ``gap``; at least one group column is needed."""
    if not group:
        raise ValueError("session windows need a group")
    out = events.withWatermark(at, lag).groupBy(F.session_window(at, gap).alias("w"), *group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, "n")


def turn_tail(records: DataFrame, session: str = "sessionid") -> DataFrame:
    """Turns of a record stream, a turn being given out when the next user record arrives.

    ``records``: ``session, record_no, role, text``. The unfinished turn of a session is
    its state (bounded: one turn); replies after it extend it. Output: ``session, turn,
    user_text, assistant_text``.
    """
    state_schema, out_schema = "turn int, user_text string, replies string", f"{session} string, turn int, user_text string, assistant_text string"

    def step(key, frames: Iterable[pd.DataFrame], state: GroupState):
        turn, user, replies = state.get if state.exists else (0, None, "")
        done = []
        rows = pd.concat(list(frames)).sort_values("record_no")
        for role, text in zip(rows["role"], rows["text"], strict=True):
            if role == "user":
                if user is not None and replies:
                    done.append((key[0], turn, user, replies))
                turn, user, replies = turn + 1, text or "", ""
            elif user is not None and text:
                replies = f"{replies}\n{text}" if replies else text
        state.update((turn, user, replies))
        yield pd.DataFrame(done, columns=[session, "turn", "user_text", "assistant_text"])

    return records.groupBy(session).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there and stops: an incremental batch whose offsets are committed."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def projecting_sink(path: str, spill_bytes: int) -> Callable[[DataFrame, int], None]:
    """Sink that projects each batch of canonical rows to documents.

    Batches are written under their id, so a batch that runs again replaces itself.
    """
    from corvidex.operators.journal import project

    def write(batch: DataFrame, batch_id: int) -> None:
        project(batch, -1, spill_bytes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def change_stamp(df: DataFrame, key: str) -> str:
    """``count:max`` of a table; a derived table is rebuilt when it changes."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("m")).first()
    return f"{r.n}:{r.m}"


def incremental_index(docs: DataFrame, indexed: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Documents to (re-)index and index keys to delete."""
    todo = docs.join(indexed.select(key, digest), [key, digest], "left_anti")
    gone = indexed.join(docs.select(key), key, "left_anti").select(key)
    return todo, gone


def resume_offsets(files: DataFrame, state: DataFrame, parser_version: int) -> DataFrame:
    """Where to resume each source: 0 if it is new, shrank, changed before the offset or the
    parser changed; else the stored offset.

    ``files``: ``path, content`` (binary); ``state``: ``path, byte_offset, prefix_hash,
    parser_version``.
    """
    j = files.join(state, "path", "left")
    same = (F.octet_length("content") >= F.col("byte_offset")) & (F.sha2(F.substring(F.col("content"), F.lit(1), F.col("byte_offset").cast("int")), 256) == F.col("prefix_hash"))
    ok = F.coalesce(same & (F.col("parser_version") == parser_version), F.lit(False))
    return j.select("path", F.when(ok, F.col("byte_offset")).otherwise(F.lit(0).cast("long")).alias("resume_at"), (~ok).alias("full_rescan"))
