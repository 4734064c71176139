"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt by a hash of their id into shards of about ``SHARD_ROWS``;
queries come in blocks of about ``QUERY_BLOCK``, and a task holds one shard
and one block. It splits its shard at medians of the widest dimension into
leaves, keeps the tight bounding box of every node, and searches each query
best first: a box's bound is the largest inner product any point in it could
have, and the search ends when no box left can reach the k-th score found. A
first round over one shard gives every query a k-th score from which all
other shards start.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_BLOCK, LEAF_ROWS = 4096, 2048, 64
_LOWEST = -(1 << 63)


class Tree:
    """Nodes as arrays: boxes, children (-1: leaf) and ranges of rows."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.children, self.range = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            node = len(self.lo)
            self.lo.append(own.min(axis=0))
            self.hi.append(own.max(axis=0))
            self.children.append([-1, -1])
            self.range.append((a, b))
            if parent >= 0:
                self.children[parent][side] = node
            spread = self.hi[node] - self.lo[node]
            if b - a > leaf_rows and spread.max() > 0:  # equal points stay together
                m = (b - a) // 2
                by = np.argpartition(own[:, int(spread.argmax())], m)
                self.order[a:b] = self.order[a:b][by]
                todo += [(a + m, b, node, 1), (a, a + m, node, 0)]
        self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple]:
    """(query id, id, score) of each query's k best points that reach its floor, but for those with its own id."""
    tree = Tree(points)
    bounds = np.maximum(queries, 0) @ tree.hi.T + np.minimum(queries, 0) @ tree.lo.T  # exact: a box corner per node
    found = []
    for q, own, floor, bound in zip(queries, query_ids, floors, bounds):
        heap = [(-int(bound[0]), 0)]
        best_s, best_i = np.zeros(0, dtype=points.dtype), np.zeros(0, dtype=np.int64)
        kth = int(floor)
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            left, right = tree.children[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-int(bound[child]), child))
                continue
            rows = tree.order[slice(*tree.range[node])]
            s = points[rows] @ q
            take = (s >= kth) & (ids[rows] != own)
            if take.any():
                best_s, best_i = np.r_[best_s, s[take]], np.r_[best_i, ids[rows][take]]
                if len(best_s) > k:
                    top = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[top], best_i[top]
                if len(best_s) >= k:
                    kth = max(kth, int(best_s.min()))
        found += [(own, i, s) for i, s in zip(best_i, best_s)]
    return found


def _exact(values: list, other: list) -> tuple[np.ndarray, np.ndarray]:
    """Both as matrices of whole numbers: 64-bit, or Python's own where sums might not fit."""
    a, b = np.stack(values), np.stack(other)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] if a.size else 0
    return (a, b) if most < 2 ** 62 else (a.astype(object), b.astype(object))


def _searcher(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            points, asked = _exact(vectors["v"].tolist(), queries["q_v"].tolist())
            rows = search(points, vectors["vec_id"].to_numpy(), asked, queries["q_id"].to_numpy(), queries["kth"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, dim, v): floor(scale * component) of the vectors without null or non-finite components."""
    ok = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
            .filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
            .select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale)).alias("v")))


def top_k(vectors: DataFrame, query_every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    all rows with another id and as many components. Null ids, null vectors
    and vectors with null or non-finite components take no part, empty
    vectors score 0. Rows that repeat an id are candidates of their own;
    repeated queries (same id and vector) count once. A table without queries
    or candidates gives an empty result.
    """
    rows = quantised(vectors, id_col, vec_col)
    asked = rows.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"])
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = asked.select(F.col("vec_id").alias("q_id"), F.col("dim").alias("q_dim"), F.col("v").alias("q_v"),
                         F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("q_block"))

    def searched(part: DataFrame, queries: DataFrame, first: int, last: int) -> DataFrame:
        # every block of queries meets every shard; rows are sent once per block, queries once per shard
        a = part.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = queries.withColumn("q_shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        pairs = a.groupBy("dim", "shard", "block").cogroup(b.groupBy("q_dim", "q_shard", "q_block"))
        return pairs.applyInPandas(_searcher(k), "query_id long, vec_id long, score long")

    found = searched(placed.filter("shard = 0"), asked.withColumn("kth", F.lit(_LOWEST)), 0, 0)
    if shards > 1:
        low = (found.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") == k).select(F.col("query_id").alias("l_id"), "low"))
        floors = asked.join(low, F.col("q_id") == F.col("l_id"), "left").withColumn("kth", F.coalesce("low", F.lit(_LOWEST)))
        found = found.unionByName(searched(placed.filter("shard > 0"), floors.drop("l_id", "low"), 1, shards - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
