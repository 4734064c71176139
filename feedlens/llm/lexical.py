"""Ranked lexical search over norm buckets of impact vectors.

A document's vector has a coordinate for each term of the queries:
sqrt(weight) * impact; a query's is sqrt(weight). Their inner product is the
score. Documents are range-partitioned by the length of their vectors, longest
first, and stored; a bucket is a run of ``BUCKET_ROWS`` of them.

- Cauchy-Schwarz: a query with k-th score t skips every bucket whose longest
  vector times its own length is below t. What is below that for every query
  is not even read: the length is a column whose statistics Parquet keeps.
- Coordinate bounds: the largest coordinate of each term in the bucket bounds
  what a query's terms can add. Its heaviest terms are taken, as many as it
  needs for the others to stay below t together, so a document without any of
  them is out. For the rest, the inverted lists of these terms give that part
  of the score, and what is left is bounded both by the other terms' largest
  coordinates and by the lengths of what is left on either side.
- The survivors are scored in 64-bit integers.

The first shard, that of the longest vectors, gives each query a k-th score;
the others start from it, and each task raises it by what it finds itself.
Queries are dealt into blocks of about ``BLOCK_TERMS`` terms, one pass over
the documents each, so that what is broadcast (a block's terms and vectors)
is bounded. Documents are never grouped by term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import Stored, frozen

#: Terms of the contract: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: what is no part of a term becomes a blank.
_BYTES = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms of a block of queries; rows of a bucket.
BLOCK_TERMS, BUCKET_ROWS = 1 << 18, 1024
#: Null ids while searching: they come first among equals.
_NO_ID = -(1 << 63)
#: What a rounding error may take from a bound.
_SLACK = 1 + 1e-9


def query_terms(text) -> F.Column:
    """The distinct terms of a text; none for null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM_RE), F.lit(0))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(values: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), tids and tfs (the vocabulary's terms among them) of the documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            keep, ns, sizes, tids, tfs = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words = text.encode("utf-8", "replace").translate(_BYTES).split() if text else []
                if words:
                    hits = [(number[t], f) for t, f in Counter(words).items() if t in number]
                    keep.append(row)
                    ns.append(len(words))
                    sizes.append(len(hits))
                    tids += [t for t, _ in hits]
                    tfs += [f for _, f in hits]
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(keep)), pa.array(ns, pa.int64()), _lists(np.array(tids, np.int32), sizes),
                     _lists(np.array(tfs, np.int32), sizes)], ["doc_id", "n", "tids", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, tids array<int>, tfs array<int>")


def _csr(b: pa.RecordBatch, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, terms, values) of a batch's lists."""
    lists = b.column("tids")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy(), b.column(values).flatten().to_numpy()


def _impacts(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, length, tids, impacts of the documents whose vector is not zero."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            starts, tids, tfs = _csr(b, "tfs")
            sizes = np.diff(starts)
            m = np.array([10 + 90 * n * n_docs // n_terms for n in b.column("n").to_pylist()], dtype=np.int64)
            tf = tfs.astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            length = np.sqrt(np.bincount(row, weights=w[tids] * impact.astype(np.float64) ** 2, minlength=len(sizes)))
            kept = np.flatnonzero(length > 0)
            if len(kept):
                some = (length > 0)[row]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(kept)).fill_null(_NO_ID), pa.array(length[kept]), _lists(tids[some], sizes[kept]),
                     _lists(impact[some].astype(np.int32), sizes[kept])], ["doc_id", "length", "tids", "impacts"])

    return counts.mapInArrow(impacts, "doc_id long, length double, tids array<int>, impacts array<int>")


class Bucket:
    """Vectors of a run of documents: by row, and as inverted lists."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, starts: np.ndarray, tids: np.ndarray, impacts: np.ndarray):
        self.ids, self.length, self.starts, self.tids, self.impacts = ids, length, starts, tids, impacts.astype(np.int64)
        by = np.argsort(tids, kind="stable")
        self.row, self.by_term = np.repeat(np.arange(len(ids)), np.diff(starts))[by], self.impacts[by]
        term = tids[by]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.terms, self.first = term[first], np.r_[first, len(term)]
        self.most = np.maximum.reduceat(self.by_term, first)

    def lists(self, tids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the lists of some terms begin and end, and their largest impacts (0: no list)."""
        at = np.minimum(np.searchsorted(self.terms, tids), len(self.terms) - 1)
        there = self.terms[at] == tids
        return self.first[at], np.where(there, self.first[at + 1], self.first[at]), np.where(there, self.most[at], 0)


class Query:
    """A query's terms, heaviest first."""

    def __init__(self, tids: np.ndarray, weights: np.ndarray):
        by = np.lexsort((tids, -weights))
        self.tids, self.weights = tids[by], weights[by].astype(np.int64)
        self.length = float(np.sqrt(self.weights.sum()))
        self.sorted = np.argsort(self.tids)


def survivors(b: Bucket, q: Query, least: int) -> np.ndarray:
    """Rows of the bucket whose bound reaches ``least`` (at least 1)."""
    low, high, most = b.lists(q.tids)
    can = q.weights * most
    by = np.argsort(-can, kind="stable")
    rest = can.sum() - np.r_[0, np.cumsum(can[by])]  # what the terms from here on can add
    n = int((rest >= least).sum())  # the essential terms: those behind them stay below
    if not n:
        return np.zeros(0, dtype=np.int64)
    part, square = np.zeros(len(b.ids), dtype=np.int64), np.zeros(len(b.ids))
    for i in by[:n].tolist():
        row, x, w = b.row[low[i]:high[i]], b.by_term[low[i]:high[i]], q.weights[i]
        part[row] += w * x
        square[row] += w * (x.astype(np.float64) ** 2)
    left = np.sqrt(float(q.weights[by[n:]].sum())) * np.sqrt(np.maximum(b.length ** 2 * (1 + 1e-12) - square, 0))
    return np.flatnonzero((part > 0) & (part + np.minimum(left * _SLACK + 1, rest[n]) >= least))


def scores(b: Bucket, q: Query, rows: np.ndarray) -> np.ndarray:
    """Exact scores of some rows, by their vectors where these are fewer entries than the query's lists."""
    low, high, _ = b.lists(q.tids)
    sizes = b.starts[rows + 1] - b.starts[rows]
    if sizes.sum() < (high - low).sum():
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.starts[rows] - (ends - sizes), sizes)
        tids, weights = q.tids[q.sorted], q.weights[q.sorted]
        place = np.minimum(np.searchsorted(tids, b.tids[at]), len(tids) - 1)
        part = np.where(tids[place] == b.tids[at], weights[place] * b.impacts[at], 0)
        return np.add.reduceat(np.r_[part, 0], ends - sizes) if len(rows) else np.zeros(0, np.int64)
    total = np.zeros(len(b.ids), dtype=np.int64)
    for lo, hi, w in zip(low, high, q.weights):
        total[b.row[lo:hi]] += w * b.by_term[lo:hi]
    return total[rows]


class Search:
    """The k best documents of each query among the buckets seen, from k-th scores known before."""

    def __init__(self, queries: list[Query], least: np.ndarray, k: int):
        self._queries, self._least, self._k = queries, least.copy(), k
        self._length = np.array([q.length for q in queries])
        self._ids, self._scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0, np.int64)] * len(queries)
        self.pruned = self.dropped = self.scored = 0  # (query, bucket) pairs; documents dropped by bounds, documents scored

    def add(self, b: Bucket) -> None:
        active = np.flatnonzero(self._length * float(b.length.max()) * _SLACK >= self._least)
        self.pruned += len(self._queries) - len(active)
        for i in active.tolist():
            q = self._queries[i]
            rows = survivors(b, q, self._least[i])
            self.dropped += len(b.ids) - len(rows)
            self.scored += len(rows)
            s = scores(b, q, rows)
            good = s >= self._least[i]
            if not good.any():
                continue
            ids, s = np.r_[self._ids[i], b.ids[rows[good]]], np.r_[self._scores[i], s[good]]
            if len(ids) > self._k:
                top = np.lexsort((ids, -s))[:self._k]
                ids, s = ids[top], s[top]
            self._ids[i], self._scores[i] = ids, s
            if len(ids) == self._k:
                self._least[i] = max(self._least[i], s.min())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(x) for x in self._ids]
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self._ids), np.concatenate(self._scores)


def _searched(vectors: DataFrame, shared, least: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): each task's best documents, q the number of the query in its block."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(shared.value, least, k)
        for b in batches:
            starts, tids, impacts = _csr(b, "impacts")
            ids, length = b.column("doc_id").to_numpy(), b.column("length").to_numpy()
            for lo in range(0, len(ids), BUCKET_ROWS):
                hi = min(lo + BUCKET_ROWS, len(ids))
                x, y = starts[lo], starts[hi]
                found.add(Bucket(ids[lo:hi], length[lo:hi], starts[lo:hi + 1] - x, tids[x:y], impacts[x:y]))
        q, ids, s = found.result()
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids), pa.array(s)], ["q", "doc_id", "score"])

    return vectors.mapInArrow(search, "q int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def _block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of queries (rows with item_id and terms)."""
    spark = docs.sparkSession
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in asked for t in r.terms}))}
    counts = Stored(_term_counts(docs, vocabulary), "terms")
    n_docs, n_terms = counts.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    held = counts.df.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    for r in held.collect():  # at most a row for each term of the block
        weights[r.tid] = weight(n_docs, r.df)
    terms = [np.array([vocabulary[t.encode()] for t in r.terms], dtype=np.int32) for r in asked]
    queries = [Query(t, weights[t]) for t in terms]
    shared = spark.sparkContext.broadcast(queries)
    order = [F.desc("length"), F.xxhash64("doc_id")]
    vectors = Stored(_impacts(counts.df, weights, n_docs, n_terms).repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("shard", F.spark_partition_id()), "impacts")
    counts.drop()
    least = np.ones(len(queries), dtype=np.int64)  # scores have to be above 0
    first = frozen(_ranked(_searched(vectors.df.filter("shard = 0").drop("shard"), shared, least, k), k))
    for r in first.filter(F.col("rank") == k).collect():  # at most a row for each query of the block
        least[r.q] = max(1, r.score)
    lowest = min((t / q.length for t, q in zip(least.tolist(), queries) if q.length), default=math.inf) / _SLACK
    rest = vectors.df.filter((F.col("shard") > 0) & (F.col("length") >= lowest)).drop("shard")
    best = frozen(_ranked(first.select("q", "doc_id", "score").unionByName(_searched(rest, shared, least, k)), k))
    vectors.drop()
    names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], "i int, item_id long"))
    return best.join(names, F.col("q") == F.col("i")).select(
        "item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 of each item, equal scores by ascending id.

    Null and empty texts have no terms: such documents count nowhere, such
    items have no rows. Repeated documents are documents of their own; rows
    of ``items`` that repeat both id and text count once, those that repeat an
    id with another text are ranked apart. Null document ids come first among
    equal scores and stay null (the smallest long is taken for null); a null
    item id stays null. Other columns are not read; an empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = frozen(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).dropDuplicates()
                   .select("item_id", F.xxhash64("item_id", "text").alias("h"), query_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0))
    n = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = math.ceil(n / block_terms)
    dealt = asked.withColumn("block", F.pmod("h", F.lit(max(1, blocks))))
    parts = [_block(rows, own, k) for i in range(blocks) if (own := dealt.filter(F.col("block") == i).select("item_id", "terms").collect())]
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty
