"""Full-text search: tokens, postings, boolean matching and BM25.

Two ways to search, with the same results:

* ``Index.search`` reads a postings table with positions, written once by ``write_index``:
  partitions are buckets of the first two characters of a term and files are sorted by
  term, so a query (words, prefixes, phrases, NEAR) reads the pages of its terms only;
* ``search_scan`` reads the documents: each phrase is counted inside the row. It needs no
  index and is what the index is tested against.

BM25 is ``-sum idf * f*(k1+1) / (f + k1*(1 - b + b*len/avglen))`` over the phrases of the
query, ``idf = ln((N-n+0.5)/(n+0.5))`` with a floor, smaller is better. N, n and the mean
length are those of a document's database; lengths count all columns.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.functions.text import search_body, tokens
from corvidex.operators.timestamps import let
from corvidex.plans.planner import Node, Phrase, parse_match
from corvidex.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage

# fixed values: BM25 parameters and the floor of idf
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
COLUMNS = ("file_path", "file_name", "content")


def index_source(docs: DataFrame, body: str = "content", extract: bool = True) -> DataFrame:
    """``origin_db, doc_id`` and token arrays ``t_<column>`` and ``n_tokens`` per document."""
    text = search_body(F.col(body)) if extract else F.col(body)
    arrays = {"t_file_path": tokens(F.col("file_path")), "t_file_name": tokens(F.col("file_name")), "t_content": tokens(text)}
    out = docs.select("origin_db", "doc_id", *[a.alias(n) for n, a in arrays.items()])
    return out.withColumn("n_tokens", sum((F.size(f"t_{c}") for c in COLUMNS), F.lit(0)))


#: Positions of a column are shifted by its number times this, so one list serves all columns
#: and tokens of different columns are never near each other.
COLUMN_STEP = 1 << 40


def _grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of the documents of one batch: sorted by document and term, without a loop over rows."""
    parts = []
    for c, name in enumerate(COLUMNS):
        lists = batch.column(f"t_{name}")
        size = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
        terms = pc.list_flatten(lists).dictionary_encode()
        code = np.asarray(terms.indices, dtype=np.int64)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((place, code, row))
        row, code = row[order], code[order]
        begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(code) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(code)] if len(code) else begins
        positions = pa.LargeListArray.from_arrays(pa.array(np.r_[begins, len(code)], pa.int64()), pa.array(place[order] + c * COLUMN_STEP, pa.int64()))
        at = pa.array(row[begins])
        parts.append(
            pa.RecordBatch.from_arrays(
                [batch.column("origin_db").take(at), terms.dictionary.take(pa.array(code[begins])), batch.column("doc_id").take(at), pa.array([name] * len(begins), pa.string()), batch.column("n_tokens").take(at), pa.array((ends - begins).astype(np.int32)), positions.cast(pa.list_(pa.int64()))],
                names=["origin_db", "term", "doc_id", "col", "n_tokens", "tf", "positions"],
            )
        )
    return pa.concat_batches(parts)


def build_postings(source: DataFrame) -> DataFrame:
    """``origin_db, term, doc_id, col, n_tokens, tf, positions`` of ``index_source``.

    A document (a row; its identity is database and id) is grouped where it lies, so nothing
    is shuffled. Documents without tokens have no postings; NULL columns count as empty.
    """

    def run(batches):
        for b in batches:
            yield _grouped(b)

    kind = {c: source.schema[c].dataType.simpleString() for c in ("origin_db", "doc_id")}
    rows = source.select("origin_db", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[f"t_{c}" for c in COLUMNS])
    return rows.mapInArrow(run, f"origin_db {kind['origin_db']}, term string, doc_id {kind['doc_id']}, col string, n_tokens long, tf int, positions array<long>")


#: Characters of a term that name its bucket: prefixes of at least so many read one bucket.
HEAD = 2
#: Documents whose postings of one bucket go into one file before the bucket is split.
DOCS_PER_FILE = 5_000_000


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term[:HEAD].encode("utf-8")) % buckets


def write_index(source: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes ``postings`` (partitioned by bucket, sorted by term) and ``totals`` per database.

    Frequent terms are spread over files by document, so no task gets a whole bucket of a
    large corpus. The folder must be one that all executors share.
    """
    spread = max(1, -(-source.count() // DOCS_PER_FILE))
    rows = build_postings(source).withColumn("bucket", (F.crc32(F.encode(F.substring("term", 1, HEAD), "UTF-8")) % buckets).cast("int"))
    placed = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    placed.sortWithinPartitions("bucket", "term", "origin_db", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # lengths come from what was written: the texts are cut into tokens once
    kind = source.schema["doc_id"].dataType.simpleString()
    lengths = source.sparkSession.read.schema("origin_db string, tf int").parquet(f"{path}/postings").groupBy("origin_db").agg(F.sum("tf").alias("tokens"))
    docs = source.groupBy("origin_db").agg(F.count(F.lit(1)).alias("n_docs"))
    same = docs.origin_db.eqNullSafe(lengths.origin_db)
    totals = docs.join(lengths, same, "left").select(docs.origin_db, "n_docs", (F.coalesce("tokens", F.lit(0)) / F.col("n_docs")).alias("avg_tokens"))
    totals.withColumns({"buckets": F.lit(buckets), "doc_type": F.lit(kind)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def open_index(spark: SparkSession, path: str) -> Index:
    totals = spark.read.parquet(f"{path}/totals")
    n, buckets, kind = totals.agg(F.count(F.lit(1)), F.max("buckets"), F.max("doc_type")).first()
    schema = f"origin_db string, term string, doc_id {kind or 'bigint'}, col string, n_tokens long, tf int, positions array<long>, bucket int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), totals, n, buckets or 1)


@dataclass
class Index:
    """A written index. ``n_databases`` was counted when it was opened and bounds what is broadcast."""

    postings: DataFrame
    totals: DataFrame
    n_databases: int
    buckets: int

    def rows_of(self, phrases: list[Phrase]) -> DataFrame:
        """Postings of the terms of some phrases; only their buckets are listed in the scan."""
        words = {(w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)}
        rows = self.postings
        if not any(prefix and len(w) < HEAD for w, prefix in words):
            rows = rows.where(F.col("bucket").isin(sorted({bucket_of(w, self.buckets) for w, _ in words})))
        exact = sorted(w for w, prefix in words if not prefix)
        tests = [F.col("term").isin(exact)] if exact else []
        tests += [F.startswith(F.col("term"), F.lit(w)) for w, prefix in sorted(words) if prefix]
        return rows.where(functools.reduce(lambda a, b: a | b, tests))

    def search(self, query: str) -> DataFrame:
        """``origin_db, doc_id, score`` of the matching documents, as ``search_scan`` gives.

        The postings of the query's terms meet per document in one aggregate; document
        counts per phrase come from the same rows.
        """
        tree = parse_match(query)
        phrases = tree.phrases()
        near = {id(p) for n in _walk(tree) if n.op == "near" for p in n.phrases()}
        aggs, counts, starts = [F.max("n_tokens").alias("n_tokens")], [], {}
        for i, p in enumerate(phrases):
            if len(p.words) == 1 and id(p) not in near:
                aggs.append(F.sum(F.when(_is_word(p, 0), F.col("tf")).otherwise(0)).alias(f"f{i}"))
                counts.append(F.col(f"f{i}"))
                continue
            for j in range(len(p.words)):
                aggs.append(F.flatten(F.collect_list(F.when(_is_word(p, j), F.col("positions")))).alias(f"p{i}_{j}"))
            starts[id(p)] = functools.reduce(F.array_intersect, [_moved(F.col(f"p{i}_{j}"), -j) for j in range(len(p.words))])
            counts.append(F.size(starts[id(p)]))
        grouped = self.rows_of(phrases).groupBy("origin_db", "doc_id").agg(*aggs)
        numbers = [c.cast("long").alias(f"f{i}") for i, c in enumerate(counts)]
        has = {id(p): F.col(f"f{i}") > 0 for i, p in enumerate(phrases)}
        if near:  # the test needs positions, which are then dropped
            found = {id(p): c > 0 for p, c in zip(phrases, counts, strict=True)}
            hit = _matches(tree, found, lambda args, distance: _near_starts(args, distance, starts))
            counted = grouped.select("origin_db", "doc_id", "n_tokens", *numbers, hit.alias("hit"))
        else:
            counted = grouped.select("origin_db", "doc_id", "n_tokens", *numbers).withColumn("hit", _matches(tree, has))
        seen = counted.groupBy("origin_db").agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
        stats = self.totals.select("origin_db", "n_docs", "avg_tokens").join(seen, "origin_db")
        if self.n_databases <= BROADCAST_ROWS:
            stats = F.broadcast(stats)
        hits = counted.where("hit").join(stats, "origin_db")
        return hits.select("origin_db", "doc_id", _score(len(phrases)).alias("score"))


def _is_word(p: Phrase, j: int) -> Column:
    w = F.lit(p.words[j])
    same = F.startswith(F.col("term"), w) if p.prefix and j == len(p.words) - 1 else F.col("term") == w
    return same & (F.col("col") == p.column) if p.column else same


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x + by) if by else F.array_distinct(positions)


def _around(places: Column, before: int, after: int) -> Column:
    return F.flatten(F.transform(places, lambda x: F.sequence(x - before, x + after)))


def _near_starts(args: list[Node], distance: int, starts: dict[int, Column]) -> Column:
    """Whether each further phrase starts within reach of some start of the first one."""
    first = args[0].phrase
    tests = [F.size(starts[id(first)]) > 0]
    for a in args[1:]:
        reach = _around(starts[id(first)], len(a.phrase.words) + distance, len(first.words) + distance)
        tests.append(F.arrays_overlap(reach, starts[id(a.phrase)]))
    return functools.reduce(lambda x, y: x & y, tests)


def _columns(p: Phrase) -> tuple[str, ...]:
    return (p.column,) if p.column else COLUMNS


def _starts(arr: Column, p: Phrase) -> Column:
    """Positions at which a phrase starts in a token array."""
    k = len(p.words)
    is_word = lambda t, j: F.startswith(t, F.lit(p.words[j])) if p.prefix and j == k - 1 else t == p.words[j]

    def of(a: Column) -> Column:
        places = F.when(F.size(a) >= k, F.sequence(F.lit(0), F.size(a) - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: functools.reduce(lambda x, y: x & y, [is_word(F.get(a, i + j), j) for j in range(k)]))

    # bound once: inside the filter the tokens would be made anew at every position
    return let(arr, of)


def _count(p: Phrase) -> Column:
    def in_column(c: str) -> Column:
        arr = F.col(f"t_{c}")
        if len(p.words) > 1:
            return F.size(_starts(arr, p))
        w = p.words[0]
        return F.size(F.filter(arr, (lambda t: F.startswith(t, F.lit(w))) if p.prefix else (lambda t: t == w)))

    return functools.reduce(lambda a, b: a + b, [in_column(c) for c in _columns(p)])


def _near(args: list[Node], distance: int) -> Column:
    """All phrases within ``distance`` tokens of each other in one column."""

    def in_column(c: str) -> Column:
        places = [_starts(F.col(f"t_{c}"), a.phrase) for a in args]
        sizes = [len(a.phrase.words) for a in args]

        def close(j: int) -> Column:
            gap = lambda x, y: F.when(y >= x, y - x - sizes[0]).otherwise(x - y - sizes[j]) <= distance
            return let(places[j], lambda other: F.exists(places[0], lambda x: F.exists(other, lambda y: gap(x, y))))

        return functools.reduce(lambda a, b: a & b, [close(j) for j in range(1, len(args))], F.size(places[0]) > 0)

    shared = [c for c in COLUMNS if all(c in _columns(a.phrase) for a in args)]
    return functools.reduce(lambda a, b: a | b, [in_column(c) for c in shared], F.lit(False))


def _matches(tree: Node, has: dict[int, Column], near=_near) -> Column:
    if tree.op == "phrase":
        return has[id(tree.phrase)]
    if tree.op == "near":
        return near(tree.args, tree.distance)
    parts = [_matches(a, has, near) for a in tree.args]
    if tree.op == "not":
        return parts[0] & ~parts[1]
    return functools.reduce(lambda a, b: a & b if tree.op == "and" else a | b, parts)


def _score(n_phrases: int) -> Column:
    total = F.lit(0.0)
    for i in range(n_phrases):
        n, f = F.col(f"n{i}").cast("double"), F.col(f"f{i}").cast("double")
        idf = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
        norm = 1 - B + B * F.col("n_tokens") / F.col("avg_tokens")
        total = total + idf * f * (K1 + 1) / (f + K1 * norm)
    return -total


def search_scan(source: DataFrame, query: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``origin_db, doc_id, <keep>, score`` of the matching documents.

    ``source`` is ``index_source`` output (with any further columns). A query that cannot
    be parsed raises ``QuerySyntaxError``; an empty table gives an empty result.
    """
    tree = parse_match(query)
    phrases = tree.phrases()
    counted = source.withColumns({f"f{i}": _count(p) for i, p in enumerate(phrases)})
    has = {id(p): F.col(f"f{i}") > 0 for i, p in enumerate(phrases)}
    narrow = ["origin_db", "doc_id", *keep, "n_tokens", *[f"f{i}" for i in range(len(phrases))]]
    # the texts are read and cut into tokens once; statistics and scores share the few numbers kept
    counted = cut_lineage(counted.select(*narrow, _matches(tree, has).alias("hit")))
    stats = counted.groupBy("origin_db").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]
    )
    hits = counted.where("hit").join(broadcast_if_small(stats), "origin_db")
    return hits.select("origin_db", "doc_id", *keep, _score(len(phrases)).alias("score"))


def _walk(n: Node):
    yield n
    for a in n.args:
        yield from _walk(a)


def best(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits; ties end at the database and document id."""
    return hits.orderBy("score", "origin_db", "doc_id").limit(limit)


def relaxed_search(index: Index, raw: str, limit: int = 50) -> DataFrame:
    """Strict hits first, then those of the relaxed form if there are fewer than ten strict ones."""
    from corvidex.plans.planner import RELAX_BELOW, normalize_query, plan_query

    plan = plan_query(raw)
    strict = best(index.search(normalize_query(plan.strict)), limit).withColumn("form", F.lit(0))
    if plan.explicit or plan.relaxed is None or strict.limit(RELAX_BELOW).count() >= RELAX_BELOW:
        return strict
    loose = best(index.search(plan.relaxed), limit).withColumn("form", F.lit(1))
    first = Window.partitionBy("origin_db", "doc_id").orderBy("form")
    merged = strict.unionByName(loose).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return merged.orderBy("form", "score", "origin_db", "doc_id").limit(limit)
