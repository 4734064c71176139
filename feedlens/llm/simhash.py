"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set if more than half of its word shingles'
XXH64 values have it set. Documents link if their fingerprints differ in at
most ``radius`` bits.

Candidates: the 64 bits are cut into radius + 2 blocks. Two fingerprints within
the radius differ in at most ``radius`` blocks, so at least two whole blocks
are equal: each distinct fingerprint goes to one bucket per pair of blocks,
and no link is missed. Exact copies share a fingerprint and meet before that.
A bucket beyond ``BUCKET_ROWS`` is cut into parts, and pairs of parts are
compared apart, so that no task gets more than two parts.

Comparison: the rows of a bucket lie in blocks of 64, stored vertically - one
64-bit word per bit position. A fingerprint is held against a block by XOR
with each plane; carry-save counters (three bit planes and an overflow plane)
add up 64 distances at once, and a block is abandoned as soon as all its
distances exceed the radius. Of the links in a bucket only a spanning forest
leaves the task, at most one row per fingerprint, which keeps the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen
from feedlens.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
BUCKET_ROWS = 4096
HASH_SEED = 42
#: Query-block pairs compared at a time: bounds a task's memory.
PAIRS_AT_ONCE = 1 << 13
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as an unsigned number; 0 without words (null, empty)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                 dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a long (the same 64 bits, signed)."""
    @F.pandas_udf("long")
    def f(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))
    return f(text)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit k of word p of block b is bit p of fingerprint 64 b + k."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    vertical = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(vertical).view("<u8").reshape(-1, 64)


def within(query: np.ndarray, planes: np.ndarray, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Per pair (query[i], planes[i]): the rows of the block, among ``wanted``, at most ``radius`` bits away.

    Counts up to 7 lie in three planes; a carry out of them stays in ``over``.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to 7")
    result = np.zeros(len(query), dtype=np.uint64)
    at = np.arange(len(query))
    alive = wanted.copy()
    c0, c1, c2, over = (np.zeros(len(query), dtype=np.uint64) for _ in range(4))
    for p in range(64):
        x = planes[at, p] ^ np.where((query[at] >> np.uint64(p)) & np.uint64(1), _FULL, np.uint64(0))
        carry = c0 & x
        c0 = c0 ^ x
        x, carry = carry, c1 & carry
        c1 = c1 ^ x
        x, carry = carry, c2 & carry
        c2 = c2 ^ x
        over |= carry
        if p % 8 == 7:
            alive &= ~(over | _exceeds(c0, c1, c2, radius))
            keep = alive != 0  # blocks in which all distances exceed the radius are abandoned
            if not keep.all():
                at, alive, c0, c1, c2, over = (v[keep] for v in (at, alive, c0, c1, c2, over))
                if not len(at):
                    break
    result[at] = alive
    return result


def _exceeds(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Bit by bit: the three-bit count is greater than ``radius``."""
    greater, equal = np.zeros_like(c0), np.full_like(c0, _FULL)
    for plane, bit in ((c2, radius & 4), (c1, radius & 2), (c0, radius & 1)):
        if not bit:
            greater |= equal & plane
            equal &= ~plane
        else:
            equal &= plane
    return greater


def forest(group: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by ``group``: the index of each row's representative, equal for rows that links join."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    which = np.repeat(np.arange(len(starts)), ends - starts)
    first, last = starts[which], ends[which]
    planes = bit_planes(fps)
    label = np.arange(n)
    blocks = (last - 1) // 64 - first // 64 + 1  # blocks that the row's group touches
    cuts = np.cumsum(blocks)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(cuts, (cuts[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
        rows = np.arange(low, high)
        q = np.repeat(rows, blocks[low:high])
        b = first[q] // 64 + (np.arange(len(q)) - np.repeat(np.cumsum(blocks[low:high]) - blocks[low:high], blocks[low:high]))
        # rows of the block that are in the group, behind the query: each pair is judged once
        from_bit = np.clip(q + 1 - 64 * b, 0, 64)
        to_bit = np.clip(last[q] - 64 * b, 0, 64)
        wanted = _ones(to_bit) & ~_ones(from_bit)
        some = wanted != 0
        q, b, wanted = q[some], b[some], wanted[some]
        hits = within(fps[q], planes[b], wanted, radius)
        hit = hits != 0
        at, bit = np.nonzero(np.unpackbits(hits[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        _join(label, q[hit][at], 64 * b[hit][at] + bit)
        low = high
    return label


def _ones(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, n from 0 to 64."""
    return np.where(n >= 64, _FULL, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows that the pairs (a, b) join the smallest of their labels."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _bucket_links(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def out(df: pd.DataFrame) -> pd.DataFrame:
            fresh = np.zeros(len(df), dtype=bool)
            for c in ("g", "k", "i", "j"):
                v = df[c].to_numpy()
                fresh[1:] |= v[1:] != v[:-1]
            group, fps = np.cumsum(fresh), df["fp"].to_numpy()
            label = forest(group, fps.view(np.uint64), radius)
            linked = label != np.arange(len(df))
            return pd.DataFrame({"a": fps[linked], "b": fps[label[linked]]})

        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            last = df.iloc[-1]
            same = ((df["g"] == last["g"]) & (df["k"] == last["k"]) & (df["i"] == last["i"]) & (df["j"] == last["j"])).to_numpy()
            cut = len(df) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = df.iloc[cut:].reset_index(drop=True)  # the last bucket may go on in the next batch
            if cut:
                yield out(df.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest):
            yield out(rest)
    return links


def _masks(radius: int) -> list[int]:
    """Bit masks of the pairs of blocks, as signed longs."""
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [sum(1 << p for p in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes`` that span their components."""
    keyed = nodes.select("fp").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(_masks(radius)) - 1))))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius)])
    keyed = keyed.withColumn("k", F.col("fp").bitwiseAND(F.element_at(masks, F.col("g") + 1)))
    sizes = (keyed.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("g").alias("sg"), F.col("k").alias("sk"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")))
    sizes = frozen(sizes)  # so that the join reads plain exchanges, which Spark splits at hot keys
    shared = keyed.join(sizes, (F.col("g") == F.col("sg")) & (F.col("k") == F.col("sk")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = (shared.withColumn("p", part)
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("g", "k", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "fp"))
    together = pairs.repartition("g", "k", "i", "j").sortWithinPartitions("g", "k", "i", "j", "fp")
    return together.mapInPandas(_bucket_links(radius), "a long, b long")


def components(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``fps`` (doc_id, fp); component_id is
    the smallest doc_id that links reach, root its smallest fingerprint. Null ids count only where a component has no other."""
    nodes = frozen(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(nodes, radius, bucket_rows))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # written, so that the join reads plain exchanges, which Spark splits at a hot root
    smallest = frozen(rooted.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")))
    return rooted.join(smallest, F.col("root") == F.col("r")).select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                       radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Repeated rows come back repeated; a null id stays null and gets its
    component's smallest id (null if it has none). Other columns of ``docs``
    are not read; an empty table gives an empty result.
    """
    fps = frozen(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    comp = components(fps, radius).withColumnRenamed("fp", "c_fp")
    return (fps.join(comp, F.col("fp") == F.col("c_fp"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                      radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component left: that of the smallest id (any one of rows that repeat it
    with the same fingerprint). All columns stay as they are."""
    narrow = frozen(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    comp = components(narrow, radius).withColumnRenamed("fp", "c_fp")
    winners = (narrow.join(comp, (F.col("fp") == F.col("c_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
               .groupBy("root").agg(F.min("component_id").alias("_sim_w_id"), F.min("fp").alias("_sim_w_fp"), F.count(F.lit(1)).alias("_sim_w_n")))
    winners = frozen(winners.drop("root"))
    if narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # an id names its row: no text is read twice
        ids = winners.select("_sim_w_id")
        return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids["_sim_w_id"]), "left_semi")
    rows = docs.withColumn("_sim_fp", fingerprint_column(F.col(text_col), shingle))
    kept = rows.join(winners, rows[id_col].eqNullSafe(winners["_sim_w_id"]) & (F.col("_sim_fp") == F.col("_sim_w_fp")))
    if not winners.filter("_sim_w_n > 1").isEmpty():  # only repeated rows have to meet
        several = kept.filter("_sim_w_n > 1").dropDuplicates([id_col, "_sim_fp"])
        kept = kept.filter("_sim_w_n = 1").unionByName(several)
    return kept.drop("_sim_fp", "_sim_w_id", "_sim_w_fp", "_sim_w_n")
