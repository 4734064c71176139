"""Benchmark decontamination by greedy string tiling.

Words are compared lower-cased and without signs at their ends. Seeds are the
Karp-Rabin hashes of ``min_match`` consecutive words. The benchmark's seeds are
a table (item, position, seed); those of the documents that could be among
them - a bitmap of fixed size tells - are equi-joined with it on the seed, and
the words of a seed, not its hash, confirm the match. For a document and a test
item, runs of matching seeds on one diagonal are the maximal matches; the
longest is marked as a tile, what overlaps it is cut back, and so on until none
of ``min_match`` words is left. Tiles may lie in any order, so a passage whose
sentences were moved still counts.

A document is contaminated by an item if tiles cover at least ``threshold`` of
the item's words; an item of at most twice ``min_match`` words must be covered
whole, as one common run of words says little about it. An item shorter than
``min_match`` has one seed, all its words.

Only matches of seeds are shuffled. A seed that very many documents share is a
hot key of an equi-join, which Spark splits; the matches of one document lie in
one task, no more than its words times the items that hold them.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen, put_back, set_aside

#: Words of the shortest tile, and the part of an item that tiles must cover.
MIN_MATCH, THRESHOLD = 4, 0.5
#: Words whose codes a task remembers; then the memory starts anew.
REMEMBER = 150_000
#: Contaminated texts up to which their digests are broadcast; beyond, documents are joined by digest.
BROADCAST_TEXTS = 1_000_000
_SIGNS = ".,;:!?\"'()[]{}<>«»…–—-&%#*=_/\\|~`^$@+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap's address: 4 MB for each length of seeds, whatever the benchmark.
_FILTER_BITS = 22


def _code(word: str) -> int:
    """64-bit code of a word; 0 if it has only signs."""
    w = word.strip(_SIGNS).encode("utf-8", "replace")
    return ((zlib.crc32(w) << 32 | zlib.crc32(w, 0x5BD1E995)) | 1) if w else 0


class Words(dict):
    """word -> code, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        c = self[word] = _code(word)
        return c


def codes(text: str | None, known: Words) -> np.ndarray:
    words = text.lower().split() if text else []
    c = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    return c[c != 0] if len(c) and not c.all() else c


def seeds(c: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k codes."""
    if len(c) < k:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(c) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + c[i: i + len(h)]
    return h


def tiles(runs: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (start in the item, start in the document, words):
    the longest first, ties to the smaller starts; what is marked is cut out of the others."""
    heap = [(-n, i, j) for i, j, n in runs if n >= min_match]
    heapq.heapify(heap)
    marked_i, marked_j, found = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + d not in marked_i and j + d not in marked_j for d in range(n)]
        if all(free):
            found.append((i, j, n))
            marked_i.update(range(i, i + n))
            marked_j.update(range(j, j + n))
            continue
        d = 0
        while d < n:  # the unmarked parts wait for their turn
            e = d
            while e < n and free[e]:
                e += 1
            if e - d >= min_match:
                heapq.heappush(heap, (-(e - d), i + d, j + d))
            d = max(e, d + 1)
    return found


def needed(words: int, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> float:
    """Words of an item that tiles must cover."""
    return words if threshold and words <= 2 * min_match else threshold * words


def cover(i: np.ndarray, j: np.ndarray, k: int, words: int, need: float) -> tuple[int, int] | None:
    """(words covered, tiles) of an item of so many ``words`` in a document whose seeds of ``k`` words match at (i, j), sorted by
    diagonal (j - i) and i; None if less than ``need``."""
    marks = np.zeros(words + 1, dtype=np.int64)  # no tiling covers more than all seeds
    np.add.at(marks, i, 1)
    np.add.at(marks, i + k, -1)
    if (np.cumsum(marks[:-1]) > 0).sum() < need:
        return None
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])
    size = np.diff(np.r_[first, len(i)]) + k - 1
    marked = tiles([(int(i[f]), int(j[f]), int(n)) for f, n in zip(first, size)], k)
    covered = sum(t[2] for t in marked)
    return (covered, len(marked)) if covered >= need else None


def _seed_rows(c: np.ndarray, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(positions, seeds, words of each seed) of a coded text; ``at``: at these positions."""
    h = seeds(c, k)
    at = np.arange(len(h)) if at is None else at
    words = c[at[:, None] + np.arange(k)].view(np.int64) if len(at) else np.zeros((0, k), dtype=np.int64)
    return at, h[at].view(np.int64), list(words)


def _slot(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - _FILTER_BITS)


def seed_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH) -> DataFrame:
    """(item, item_id, item_words, k, i, seed, words): the seeds of every item with a word; ``item`` numbers the rows of the benchmark."""
    items = frozen(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for df in batches:
            out = []
            for item, text in zip(df["item"], df["text"]):
                c = codes(text, known)
                k = min(len(c), min_match)
                if k:
                    out += [(item, len(c), k, i, s, w) for i, s, w in zip(*_seed_rows(c, k))]
            yield pd.DataFrame(out, columns=["item", "item_words", "k", "i", "seed", "words"])

    found = items.select("item", "text").mapInPandas(run, "item long, item_words int, k int, i int, seed long, words array<long>")
    return frozen(found.join(items.select(F.col("item").alias("n"), "item_id"), F.col("item") == F.col("n")).drop("n"))


def _candidates(docs: DataFrame, table: DataFrame):
    """(row, tag, k, j, seed, words) of the documents' seeds whose place in the benchmark's bitmap is set. ``docs``: row, tag, text."""
    slots = table.select("k", F.shiftrightunsigned("seed", 64 - _FILTER_BITS).cast("int").alias("s")).distinct()
    seen: dict[int, np.ndarray] = {}
    for r in slots.collect():  # at most 2 ** _FILTER_BITS for each length
        seen.setdefault(r.k, np.zeros(1 << _FILTER_BITS, dtype=bool))[r.s] = True
    shared = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v) for k, v in seen.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = Words(), {k: np.unpackbits(v).view(bool) for k, v in shared.value.items()}
        for df in batches:
            out = []
            for row, tag, text in zip(df["row"], df["tag"], df["text"]):
                c = codes(text, known)
                for k, seen in bits.items():
                    at = np.flatnonzero(seen[_slot(seeds(c, k))])
                    out += [(row, tag, k, j, s, w) for j, s, w in zip(*_seed_rows(c, k, at))] if len(at) else []
            yield pd.DataFrame(out, columns=["row", "tag", "k", "j", "seed", "words"])

    return docs.mapInPandas(run, "row long, tag string, k int, j int, seed long, words array<long>")


def _tiled(min_match: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by document and item; the last pair of a batch may go on in the next."""
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if len(df):
                row, item = df["row"].to_numpy(), df["item"].to_numpy()
                cut = len(df) - int(np.argmin(((row == row[-1]) & (item == item[-1]))[::-1])) if (row != row[-1]).any() or (item != item[-1]).any() else 0
                rest = df.iloc[cut:]
                yield out(df.iloc[:cut])
        if rest is not None:
            yield out(rest)

    def out(df: pd.DataFrame) -> pd.DataFrame:
        found = []
        row, item, i, j = (df[c].to_numpy() for c in ("row", "item", "i", "j"))
        cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]), True]) if len(df) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            first = df.iloc[a]
            n = int(first["item_words"])
            got = cover(i[a:b], j[a:b], int(first["k"]), n, needed(n, min_match, threshold))
            if got:
                found.append((first["row"], first["tag"], first["item"], n, got[0], got[0] / n, got[1]))
        return pd.DataFrame(found, columns=["row", "tag", "item", "item_words", "covered_words", "coverage", "tiles"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(row, tag, item_id, item_words, covered_words, coverage, tiles) of the documents (row, tag, text) that an item contaminates."""
    table = seed_table(benchmark, min_match=min_match)
    own = _candidates(docs, table)
    t = table.select(F.col("k").alias("t_k"), F.col("seed").alias("t_seed"), F.col("words").alias("t_words"), "item", "item_words", "i")
    same = (F.col("k") == F.col("t_k")) & (F.col("seed") == F.col("t_seed")) & (F.col("words") == F.col("t_words"))
    met = own.join(t, same).select("row", "tag", "item", "item_words", "k", "i", "j")
    # an item is covered by no more words than its matched seeds hold
    placed = met.repartition("row").sortWithinPartitions("row", "item", F.col("j") - F.col("i"), "i")
    found = placed.mapInPandas(_tiled(min_match, threshold),
                               "row long, tag string, item long, item_words int, covered_words int, coverage double, tiles int")
    names = table.select(F.col("item").alias("n"), "item_id").distinct()
    return found.join(names, F.col("item") == F.col("n")).drop("n", "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_words, covered_words, coverage, tiles.

    Null and empty texts and items without words match nothing; a short item
    (see above) matches where all its words stand; either table may be empty.
    Rows that repeat an id are documents of their own, repeated items items of
    their own. A null id comes back null. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("tag"), F.col(text_col).alias("text"))
    found = matches(rows, benchmark, min_match, threshold)
    return found.select(F.col("tag").cast("long").alias("doc_id"), "item_id", "item_words", "covered_words", "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH,
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no test item contaminates, unchanged.

    Whether a row stays depends on its text alone, so contaminated texts are
    known by their digest (MD5 of the whole text).
    """
    digest = F.md5(F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), digest.alias("tag"), F.col(text_col).alias("text"))
    dirty = frozen(matches(rows, benchmark, min_match, threshold).select(F.col("tag").alias("_dc_dirty")).distinct())
    if dirty.count() <= BROADCAST_TEXTS:  # the documents stay where they are
        dirty = F.broadcast(dirty)
    docs, away = set_aside(docs, "_dc_")
    marked = docs.withColumn("_dc_digest", F.md5(F.col(away.get(text_col, text_col))))
    return put_back(marked.join(dirty, F.col("_dc_digest") == F.col("_dc_dirty"), "left_anti").drop("_dc_digest"), away)
