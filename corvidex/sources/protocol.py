"""What a request to the passage service may hold, as checks over rows; and a circuit breaker.

There is no HTTP service here: a request is a table, a refusal is a row with its reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: limits of one request
MAX_PASSAGE_CHARS, MAX_DOCUMENTS, MAX_PASSAGES = 4000, 200, 2000


def passage_problems(passages: DataFrame) -> DataFrame:
    """``doc_id, passage_id, problem`` of passages that a request may not hold; all problems of each.

    ``passages``: ``doc_id, passage_id, section, char_start, char_end, n_tokens, passage``.
    """
    whole = lambda c: F.when(F.coalesce(F.col(c) < 0, F.lit(True)), F.lit(f"{c} must be a whole number of 0 or more"))
    checks = F.array(
        F.when(F.col("passage").isNull(), F.lit("each passage needs a text")),
        F.when(F.char_length("passage") > MAX_PASSAGE_CHARS, F.lit("a passage is too long")),
        F.when(F.col("section").isNull(), F.lit("section must be text")),
        *[whole(c) for c in ("char_start", "char_end", "n_tokens")],
    )
    rows = passages.select("doc_id", "passage_id", F.explode(F.filter(checks, lambda p: p.isNotNull())).alias("problem"))
    twice = passages.groupBy("doc_id", "passage_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.unionByName(twice.select("doc_id", "passage_id", F.lit("passage ids must be unique").alias("problem")))


def request_batches(passages: DataFrame, documents: int = MAX_DOCUMENTS, most: int = MAX_PASSAGES) -> DataFrame:
    """``doc_id, n_passages, batch``: documents in requests of at most so many documents.

    Batches are numbered over blocks, so no task sees all documents; a document with more
    passages than a request may hold is marked by batch NULL.
    """
    from corvidex.operators.ordering import blocked_row_number

    per = passages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"))
    fits = blocked_row_number(per.where(F.col("n_passages") <= most), [], [F.col("doc_id")], "k")
    out = fits.select("doc_id", "n_passages", F.floor((F.col("k") - 1) / documents).alias("batch"))
    return out.unionByName(per.where(F.col("n_passages") > most).select("doc_id", "n_passages", F.lit(None).cast("long").alias("batch")))


@dataclass
class CircuitBreaker:
    """Stops asking a service for ``pause`` seconds after a failure. ``clock`` is for tests."""

    pause: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _until: float = field(default=0.0, repr=False)

    def call(self, ask: Callable[[], object]) -> tuple[object | None, str | None]:
        """The answer, or None and the reason it is missing."""
        if self.clock() < self._until:
            return None, "circuit open"
        try:
            out = ask()
        except Exception as x:  # whatever a service may raise: the search goes on without it
            self._until = self.clock() + self.pause
            return None, f"{type(x).__name__}: {x}"
        self._until = 0.0
        return out, None
