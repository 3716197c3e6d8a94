"""The best record of each group of duplicates, field by field (problem 5).

Fields are unpivoted to long rows; each row votes for its value. A vote weighs source trust
times recency decay, votes are summed per normalised value, a winner is chosen per field
with ``max_by``, and the winners are pivoted back to one record.

So that a better source, then a newer row, outweighs all lesser votes for another value
together, a value has one vote per trust level, its newest, and the weights are exact:

* decay is ``(2**52 + sequence) / 2**53``: linear in the order of recording, between a half
  and one, and exact in the 53 bits of a double;
* trust is ``2**-56`` per level below the best. All lesser votes of a value together are
  below half a unit in the last place of its leading vote, so sums compare by the leading
  vote, whatever the order of addition. A double spans 36 such levels; further levels are
  summed in a second number, and so on.

Only a digest of each value travels until the winners are known. Every aggregation combines
before its shuffle, so a key that holds a large part of all rows adds little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two between trust levels, and levels that one double holds.
LEVEL_BITS, LEVELS_PER_SUM = 56, 36
#: Most trust levels; a scale of sources is a small closed list.
MAX_LEVELS = 1_000


def normal_key(c: Column) -> Column:
    """Keys that differ in case, outer white space or slash direction become equal; blank is NULL."""
    k = F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(k != "", k)


def normal_value(c: Column) -> Column:
    """Form in which two values count as the same: case and white space do not matter."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def key_digest(c: Column) -> list[Column]:
    """128 bits of a normal key as two numbers, which hash aggregates can group by."""
    k = normal_key(c)
    return [F.when(k.isNotNull(), F.xxhash64(k)).alias("k1"), F.xxhash64(F.lit("second"), k).alias("k2")]


KEY = ["k1", "k2"]


def trust_levels(df: DataFrame, rank: str) -> list[int]:
    """The ranks in use, best first: the scale of trust. Reads one number column."""
    rows = df.select(F.col(rank).cast("long").alias("r")).where("r is not null").distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{rank} has more than {MAX_LEVELS} levels: not a scale of trust")
    return sorted(r.r for r in rows)


def vote_rows(df: DataFrame, key: str, fields: dict[str, Callable[[Column], Column]], rank: str, sequence: str) -> DataFrame:
    """Long rows ``k1, k2, field, value, rank, sequence`` of the values that are there.

    ``fields`` maps each field to a function that tells its empty values.
    """
    items = F.array(
        *[
            F.when(~empty(F.col(f)), F.struct(F.lit(i).alias("field"), F.xxhash64(normal_value(F.col(f))).alias("value")))
            for i, (f, empty) in enumerate(fields.items())
        ]
    )
    rows = df.select(
        *key_digest(F.col(key)), F.col(sequence).cast("long").alias("sequence"), F.col(rank).cast("long").alias("rank"), F.explode(F.filter(items, lambda x: x.isNotNull())).alias("x")
    )
    return rows.where("k1 is not null").select(*KEY, "sequence", "rank", "x.field", "x.value")


def weighed(level: Column, sequence: Column, n_levels: int) -> list[Column]:
    """Trust times decay of a vote, one number per ``LEVELS_PER_SUM`` levels (0 is the best level)."""
    decay = (F.lit(float(2**52)) + sequence.cast("double")) / F.lit(float(2**53))
    out = []
    for first in range(0, n_levels, LEVELS_PER_SUM):
        inside = level.between(first, first + LEVELS_PER_SUM - 1)
        trust = F.pow(F.lit(2.0), F.lit(LEVEL_BITS * (LEVELS_PER_SUM // 2)) - LEVEL_BITS * (level - first))
        out.append(F.when(inside, trust * decay).otherwise(0.0))
    return out


def field_winners(df: DataFrame, key: str, fields: dict, rank: str, sequence: str) -> DataFrame:
    """One row per group of two or more rows and field with a value.

    ``k1, k2`` (digest of the key), ``first_sequence``, ``field_name``, ``sequence`` (the row
    the surviving value comes from), ``votes`` (rows that had that value). NULL and blank
    keys belong to no group; groups of one row are left out; a field without any value has
    no row. A NULL rank is a level below all others. Rows that tie in rank and sequence
    end at the smaller digest of their value. Extra columns do not matter.
    """
    scale = trust_levels(df, rank)
    n_levels = len(scale) + 1  # the last one is NULL
    groups = df.select(*key_digest(F.col(key)), F.col(sequence).cast("long").alias("s")).where("k1 is not null")
    groups = groups.groupBy(*KEY).agg(F.min("s").alias("first_sequence"), F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in scale]), F.col("rank")) - 1, F.lit(len(scale))) if scale else F.lit(0)
    rows = vote_rows(df, key, fields, rank, sequence).withColumn("level", level.cast("int"))
    # one vote per value and level: its newest row
    votes = rows.groupBy(*KEY, "field", "value", "level").agg(F.max("sequence").alias("sequence"), F.count(F.lit(1)).alias("n"))
    parts = weighed(F.col("level"), F.col("sequence"), n_levels)
    names = [f"w{i}" for i in range(len(parts))]
    sums = votes.groupBy(*KEY, "field", "value").agg(
        *[F.sum(w).alias(n) for n, w in zip(names, parts, strict=True)],
        F.min_by("sequence", "level").alias("sequence"),
        F.sum("n").alias("votes"),
    )
    weight = F.struct(*names, (-F.col("value")).alias("tie"))
    won = sums.groupBy(*KEY, "field").agg(F.max_by(F.struct("sequence", "votes"), weight).alias("w"))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return won.join(groups, KEY).select(*KEY, "first_sequence", name.alias("field_name"), "w.sequence", "w.votes")


def survivors(df: DataFrame, winners: DataFrame, fields: list[str], sequence: str) -> DataFrame:
    """The winners pivoted back: one record per group with each field's surviving value."""
    source = df.select(F.col(sequence).alias("sequence"), *fields)
    picked = winners.select("first_sequence", "field_name", "sequence").join(source, "sequence")
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in fields])
    long = picked.select("first_sequence", "field_name", "sequence", value.alias("value"))
    aggs = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields]
    aggs += [F.max(F.when(F.col("field_name") == f, F.col("sequence"))).alias(f"{f}_from") for f in fields]
    return long.groupBy("first_sequence").agg(*aggs)
