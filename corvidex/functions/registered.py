"""Functions registered by name, for SQL users: scalar UDFs and table functions.

``register(spark)`` makes ``overlap_score``, ``zlib_deflate``, ``zlib_inflate``, ``stub_vectors``
(scalar, Arrow batches) and ``parse_chatlog``, ``parse_worklog``, ``split_passages``, ``zip_entries``
(table functions, used as ``FROM t, LATERAL split_passages(t.text)``) known to a session.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType

from corvidex.operators.passages import STRIDE, WINDOW
from corvidex.operators.vectors import encode_words
from corvidex.plans.planner import ascii_fold
from corvidex.sources.chatlog import parse_log
from corvidex.sources.sinks import deflate, inflate
from corvidex.sources.worklog import split_large, split_sections


@F.pandas_udf(DoubleType())
def overlap_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the distinct query words found in a text, to four places; 0 without words."""

    def one(q, t):
        words = set(re.findall(r"\w+", ascii_fold(q or "")))
        return round(len(words & set(re.findall(r"\w+", ascii_fold(t or "")))) / len(words), 4) if words else 0.0

    return pd.Series([one(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")


@udtf(returnType="dialect: string, raw_timestamp: string, user_text: string, assistant_text: string, start_line: int, end_line: int")
class ParseChatlog:
    def eval(self, text: str):
        for e in parse_log(text or ""):
            yield e["dialect"], e["raw_timestamp"], e["user"], e["assistant"], e["start_line"], e["end_line"]


@udtf(returnType="heading: string, start_line: int, end_line: int, body: string")
class ParseWorklog:
    def eval(self, text: str):
        for section in split_sections(text or ""):
            for heading, first, last, lines in split_large(section):
                yield heading, first, last, "\n".join(lines)


@udtf(returnType="passage_no: int, char_start: int, char_end: int, passage: string")
class SplitPassages:
    """Windows of a text; empty and NULL texts have none."""

    def eval(self, text: str):
        n = len(text or "")
        for i in range(1 + max(0, -(-(n - WINDOW) // STRIDE)) if n else 0):
            yield i, i * STRIDE, min(n, i * STRIDE + WINDOW), text[i * STRIDE : i * STRIDE + WINDOW]


@udtf(returnType="file_path: string, size_bytes: bigint, content: binary")
class ZipEntries:
    """Entries of an archive; what is no archive has none."""

    def eval(self, data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
                for e in z.infolist():
                    if not e.is_dir():
                        yield e.filename, e.file_size, z.read(e)
        except zipfile.BadZipFile:
            return


def register(spark: SparkSession) -> None:
    for name, fn in (("overlap_score", overlap_score), ("zlib_deflate", deflate), ("zlib_inflate", inflate), ("stub_vectors", encode_words)):
        spark.udf.register(name, fn)
    for name, fn in (("parse_chatlog", ParseChatlog), ("parse_worklog", ParseWorklog), ("split_passages", SplitPassages), ("zip_entries", ZipEntries)):
        spark.udtf.register(name, fn)
