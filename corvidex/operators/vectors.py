"""Late-interaction vectors: quantisation, MaxSim, search and a hashed encoder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Most vectors of a query that are used.
MAX_QUERY_VECTORS = 64
STUB_DIM = 16


def quantize(vec: Column) -> Column:
    """Struct of ``scale`` (largest magnitude / 127) and int8 ``codes``; NULL stays NULL."""
    scale = F.array_max(F.transform(vec, lambda x: F.abs(x).cast("double"))) / 127.0
    safe = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    codes = F.transform(vec, lambda x: F.bround(x.cast("double") / safe).cast("tinyint"))
    return F.when(vec.isNotNull(), F.struct(safe.alias("scale"), codes.alias("codes")))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c.cast("double") * q["scale"]).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def maxsim(query: Column, passage: Column) -> Column:
    """Sum over query vectors of the largest dot product with a passage vector.

    For small inputs; ``search`` scores batches with numpy.
    """
    best = lambda qv: F.array_max(F.transform(passage, lambda pv: dot(qv, pv)))
    return F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def search(vectors: DataFrame, query: list[list[float]], id_column: str, vec_column: str, k: int, multi: bool = False) -> DataFrame:
    """``id, score`` of the best ``k`` rows by MaxSim, scores to four places, ties by id.

    ``vec_column`` holds one vector, or with ``multi`` an array of vectors. The query (at
    most 64 vectors) travels in the closure; rows are scored in Arrow batches. Empty and
    NULL vectors are left out; a vector of another length is an error.
    """
    q = np.asarray(query[:MAX_QUERY_VECTORS], dtype=np.float64)
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.where(F.size(vec_column) > 0).select(F.col(id_column).alias("id"), F.col(vec_column).alias("v"))

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            if multi:
                parts = [np.stack([np.asarray(x, dtype=np.float64) for x in v]) for v in f["v"]]
                sims = q @ np.concatenate(parts).T
                starts = np.cumsum([0, *map(len, parts[:-1])])
                score = np.maximum.reduceat(sims, starts, axis=1).sum(0)
            else:
                score = (q @ np.stack(f["v"].to_numpy()).astype(np.float64).T).sum(0)
            yield pd.DataFrame({"id": f["id"], "score": score})

    out = rows.mapInPandas(run, f"id {kind}, score double").withColumn("score", F.round("score", 4))
    return out.orderBy(F.col("score").desc(), "id").limit(k).withColumnRenamed("id", id_column)


def stub_vector(word: str) -> list[float]:
    """Deterministic unit vector of a word from its SHA-256 bytes."""
    raw = np.frombuffer(hashlib.sha256(word.lower().encode()).digest()[:STUB_DIM], dtype=np.uint8).astype(np.float64) - 127.5
    return (raw / np.linalg.norm(raw)).tolist()


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def encode_words(words: pd.Series) -> pd.Series:
    """Stub token vectors of arrays of words; each distinct word is hashed once per batch."""
    known: dict[str, list[float]] = {}
    return pd.Series([None if ws is None else [known.setdefault(w, stub_vector(w)) for w in ws] for ws in words])


def missing(passages: DataFrame, vectors: DataFrame, key: str, digest: str) -> DataFrame:
    """Passages without a vector for their present content."""
    return passages.join(vectors.select(key, digest), [key, digest], "left_anti")


def index_status(passages: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Counts of passages, vectors, those still to be encoded, and vectors of no passage."""
    p, v = passages.select(key).withColumn("p", F.lit(1)), vectors.select(key).withColumn("v", F.lit(1))
    j = p.join(v, key, "full")
    return j.agg(
        F.count("p").alias("passages"), F.count("v").alias("vectors"), F.count_if(F.col("v").isNull()).alias("unindexed"), F.count_if(F.col("p").isNull()).alias("stale"),
        (F.count_if(F.col("v").isNull()) == 0).alias("complete"),
    )
