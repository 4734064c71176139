"""Substring dedup over a De Bruijn graph of words.

An edge of the graph is a window of ``WINDOW`` words, between the nodes of its
first and last words. A window whose words also start in a document with a
smaller id is a repeat, and its words go.

1. Minimizers. The smallest hash among the ``SUB``-word runs of a window names
   its bucket; neighbouring windows mostly share it. A run of windows in one
   bucket is a path that needs no join to be put together. Buckets seen in one
   document only are dropped: nothing in them repeats.
2. Paths. Each remaining path, as the array of its edges' hashes, is grouped
   with its equals: copies of a passage collapse into one row per path, with
   its first document and position (combined before the shuffle).
3. Compaction. Paths that differ may still share edges (they branch, or a copy
   was cut): the edges of the distinct paths are joined to find each edge's
   first document, and joined back to paths and to the documents on them.
4. In each document, repeated edges that lead to consecutive positions of the
   same source are one long span; its words are removed. Spans are verified by
   source coordinates: a digest of the words at the source must equal that of
   the copy's. Where hashes deceived, the span stays.

Shuffles carry minimizers (about a fifth of the words), paths of repeated
buckets, and the texts for paths, coverage and verification. Joins hash their
smaller side, partition by partition, so that neither texts nor minimizers are
sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import Stored, frozen

WINDOW, SUB = 13, 5
#: Bytes of texts that are cut into words at a time; a longer text is cut alone.
BLOCK_BYTES = 4 << 20
#: Bytes of a word up to which it is hashed with all others, eight bytes at a time; longer ones by XXH64.
LONG = 64
#: Long words whose hashes a task remembers; then the memory starts anew.
REMEMBER = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


#: True for bytes of words; masks of the first 0 to 8 bytes of a little-endian number.
_IN_WORD = np.isin(np.arange(256), [32, *range(9, 14)], invert=True)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Words(dict):
    """long word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _first(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it, and for the first."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        np.not_equal(columns[0][1:], columns[0][:-1], out=out[1:])
        for c in columns[1:]:
            out[1:] |= c[1:] != c[:-1]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, put together from runs of powers of two."""
    power, size, base = h, 1, _BASE
    out, done = None, 0
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # the runs of `size` words go before what is put together so far
                out, done = (power, size) if out is None else (power[: len(power) - done] * _pow(done) + out[size:], done + size)
            left >>= 1
            if left:
                power, size, base = power[: len(power) - size] * base + power[size:], size * 2, base * base
        return _mixed(out.copy() if k == 1 else out)


@lru_cache(maxsize=64)
def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = np.minimum(h[: len(h) - step], h[step:])
        size += step
    return h


def _hashes(words: list[bytes], known: Words) -> np.ndarray:
    """64-bit hashes of words."""
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    begin = np.append(0, end)[:-1]
    return _hashed(np.frombuffer(b"".join(words), dtype=np.uint8), begin, end, known)


def _hashed(text: np.ndarray, begin: np.ndarray, end: np.ndarray, known: Words) -> np.ndarray:
    """64-bit hashes of the words that stand from ``begin`` to ``end`` in ``text``."""
    padded = np.zeros(len(text) + 8, dtype=np.uint8)
    padded[: len(text)] = text
    eights = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
    size = end - begin
    h = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        h *= _BASE
        h ^= eights[begin] & _BYTES[np.minimum(size, 8)]
        h = _mixed(h)
        more = np.flatnonzero(size > 8)
        for done in range(8, LONG, 8):
            if not len(more):
                break
            left = size[more] - done
            h[more] = _mixed(h[more] ^ (eights[begin[more] + done] & _BYTES[np.minimum(left, 8)]))
            more = more[left > 8]
    for k in more.tolist():
        h[k] = known[text[begin[k]: end[k]].tobytes()]
    return h


def edges(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window of hashed words."""
    return _runs(h, window) if len(h) >= window else np.zeros(0, dtype=np.uint64)


def minimizers(h: np.ndarray, window: int, sub: int) -> np.ndarray:
    """Smallest hash among the ``sub``-word runs of every window."""
    return _least(_runs(h, sub), window - sub + 1) if len(h) >= window else np.zeros(0, dtype=np.uint64)


def _docs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes]]]:
    """Id and words of each document; null texts have none."""
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
        raw = text.as_py()
        yield doc, raw.split() if raw else []


class _Block:
    """Words of some rows of a batch, one row behind the other: ``begin`` and ``end`` of each in ``text``, and where the rows' words
    begin among them (``cuts``)."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        self.text, self._inside = text, _IN_WORD[text]
        inside, starts = self._inside, offsets[:-1][offsets[:-1] < offsets[-1]]
        begins, ends = np.zeros(len(text) + 1, dtype=bool), np.zeros(len(text) + 1, dtype=bool)
        if len(text):
            begins[:-1] = inside
            begins[1:-1] &= ~inside[:-1]
            begins[starts] = inside[starts]
            ends[1:] = inside
            ends[1:-1] &= ~inside[1:]
            starts = starts[starts > 0]
            ends[starts] = inside[starts - 1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.cuts = np.searchsorted(self.begin, offsets)

    def hashes(self, known: Words) -> np.ndarray:
        return _hashed(self.text, self.begin, self.end, known)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def windows(self, window: int) -> np.ndarray:
        """First words of the windows that lie in one row."""
        out = np.ones(max(0, len(self.begin) - window + 1), dtype=bool)
        over = (self.cuts[1:-1, None] - np.arange(1, window)).ravel()
        out[over[(over >= 0) & (over < len(out))]] = False
        return np.flatnonzero(out)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins."""
        at = np.append(0, np.cumsum(self.end - self.begin + 1))
        out, letters = np.full(at[-1], 32, dtype=np.uint8), np.ones(at[-1], dtype=bool)
        letters[at[1:] - 1] = False
        out[letters] = self.text[self._inside]
        return out, at


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    """The rows of a batch, some at a time, and their words; null texts have none."""
    raw = batch.column("text").cast(pa.binary()).cast(pa.large_binary())
    raw = pc.fill_null(raw, b"") if raw.null_count else raw
    if not len(raw):
        return
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(raw):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        yield batch.slice(first, last - first), _Block(data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first])
        first = last


def _minimizers(window: int, sub: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for rows, block in (x for batch in batches for x in _blocks(batch)):
            at = block.windows(window)
            m, row = minimizers(block.hashes(known), window, sub)[at], block.rows()[at]
            first = _first(m, row)
            m, row = m[first], row[first]
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                m[a:b].sort()
            first = _first(m, row)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), pa.array(ids[row[first]], pa.int64())], ["m", "doc"])
    return run


def _paths(window: int, sub: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for rows, block in (x for batch in batches for x in _blocks(batch)):
            # a bucket that any row of the block shares is wanted of every other that has it, too
            wanted = pc.unique(rows.column("buckets").flatten())
            at = block.windows(window)
            if not len(at):
                continue
            h, row = block.hashes(known), block.rows()[at]
            m = minimizers(h, window, sub)[at]
            first = np.flatnonzero(_first(m, row))
            size = np.diff(first, append=len(m))
            keep = pc.is_in(pa.array(m[first].view(np.int64)), value_set=wanted).to_numpy(zero_copy_only=False)
            path = edges(h, window)[at[np.repeat(keep, size)]]
            first, size = first[keep], size[keep]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets), pa.array(path.view(np.int64))), pa.array(ids[row[first]], pa.int64()),
                 pa.array(at[first] - block.cuts[row[first]], pa.int64())], ["path", "doc", "start"])
    return run


def _digest(text: bytes | np.ndarray) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


_SPAN = {"src_doc": pa.int64(), "src_pos": pa.int64(), "n": pa.int64(), "digest": pa.binary()}


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for rows, block in (x for batch in batches for x in _blocks(batch)):
            repeats = rows.column("repeats")
            flat, own_cuts = repeats.flatten(), repeats.offsets.to_numpy()
            own_cuts = (own_cuts - own_cuts[0]).tolist()
            edge, src_doc, src_pos = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            h = block.hashes(known) if len(edge) else None
            text, at = block.joined()
            n_removed, sha, spans, span_cuts = [], [], [], [0]
            cuts = block.cuts.tolist()
            for k, (i0, i1) in enumerate(zip(cuts, cuts[1:])):
                a, b = own_cuts[k], own_cuts[k + 1]
                kept, removed = text[at[i0]: at[i1]], 0
                if b > a:
                    gone = np.zeros(i1 - i0 + 1, dtype=np.int64)
                    order = np.argsort(edge[a:b], kind="stable")
                    own, own_doc, own_pos = edge[a:b][order], src_doc[a:b][order], src_pos[a:b][order]
                    e = edges(h[i0:i1], window).view(np.int64)
                    near = np.minimum(np.searchsorted(own, e), len(own) - 1)
                    pos = np.flatnonzero(own[near] == e)
                    if len(pos):
                        s_doc, s_pos = own_doc[near[pos]], own_pos[near[pos]]
                        step = np.arange(len(pos))
                        first = np.flatnonzero(_first(pos - step, s_doc, s_pos - step))
                        last = np.append(first[1:], len(pos)) - 1
                        for f, t in zip(first.tolist(), last.tolist()):
                            i, j = int(pos[f]), int(pos[t]) + window
                            gone[i] += 1
                            gone[j] -= 1
                            spans.append((int(s_doc[f]), int(s_pos[f]), j - i, _digest(text[at[i0 + i]: at[i0 + j] - 1])))
                        left = np.cumsum(gone[:-1]) == 0
                        removed = len(left) - int(left.sum())
                        kept = kept[np.repeat(left, np.diff(at[i0: i1 + 1]))]
                n_removed.append(removed)
                sha.append(hashlib.sha256(kept[:-1]).hexdigest())
                span_cuts.append(len(spans))
            fields = [pa.array(list(c), t) for c, t in zip(list(zip(*spans)) or [[]] * len(_SPAN), _SPAN.values())]
            listed = pa.ListArray.from_arrays(pa.array(span_cuts, pa.int32()), pa.StructArray.from_arrays(fields, list(_SPAN)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(block.cuts), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), listed],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for (doc, words), asked in zip(_docs(batch), batch.column("asked").to_pylist()):
            out += [(doc, x["src_pos"], x["n"], x["digest"], _digest(b" ".join(words[x["src_pos"]: x["src_pos"] + x["n"]])) == x["digest"]) for x in asked]
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["src_doc", "src_pos", "n", "digest", "same"])


def repeated_edges(rows: DataFrame, window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """(doc, repeats: array of (edge, src_doc, src_pos)): the distinct windows of each document that start
    in one with a smaller id, and where. ``rows``: doc_id, text."""
    named = rows.filter("doc_id IS NOT NULL")
    minimal = Stored(named.mapInArrow(_minimizers(window, sub), "m long, doc long"), "minimizers")  # read twice
    buckets = minimal.df
    shared = frozen(buckets.groupBy("m").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select(F.col("m").alias("s_m")))
    wanted = frozen(buckets.join(shared.hint("shuffle_hash"), F.col("m") == F.col("s_m")).groupBy("doc").agg(F.collect_list("m").alias("buckets")))
    minimal.drop()
    paths = Stored(named.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "buckets")
                   .mapInArrow(_paths(window, sub), "path array<long>, doc long, start long"), "paths")

    distinct = Stored(paths.df.groupBy("path").agg(F.min("doc").alias("first"), F.min_by("start", "doc").alias("at"), F.max("doc").alias("last"))
                      .withColumn("id", F.monotonically_increasing_id()), "distinct-paths")
    edge = distinct.df.select("id", "first", "at", "last", F.posexplode("path").alias("j", "h"))
    # written, so that the join below reads plain exchanges, which Spark splits at hot edges
    sources = Stored(edge.groupBy("h").agg(F.min("first").alias("src_doc"), F.min_by(F.col("at") + F.col("j"), "first").alias("src_pos"),
                                     F.max("last").alias("last"))
               .filter("src_doc < last").select(F.col("h").alias("s_h"), "src_doc", "src_pos"), "sources")
    led = (edge.select("id", "j", "h").join(sources.df.hint("shuffle_hash"), F.col("h") == F.col("s_h"))
           .groupBy("id").agg(F.collect_list(F.struct(F.col("h").alias("edge"), "src_doc", "src_pos")).alias("leads")))
    compacted = Stored(distinct.df.select("id", F.col("path").alias("c_path")).join(led.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"))
                       .select("c_path", "leads"), "compacted-paths")
    distinct.drop()
    sources.drop()

    found = paths.df.select("path", "doc").join(compacted.df.hint("shuffle_hash"), F.col("path") == F.col("c_path"))
    earlier = F.filter("leads", lambda x: x["src_doc"] < F.col("doc"))
    repeats = Stored(found.select("doc", earlier.alias("leads")).filter(F.size("leads") > 0)
                     .groupBy("doc").agg(F.flatten(F.collect_list("leads")).alias("repeats")), "repeats")
    paths.drop()
    compacted.drop()
    return repeats.df


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<src_doc:long,src_pos:long,n:long,digest:binary>>"


def _covered(rows: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    none = F.array().cast("array<struct<edge:long,src_doc:long,src_pos:long>>")
    joined = rows.join(repeats.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", F.coalesce("repeats", none).alias("repeats"))
    return joined.mapInArrow(_removed(window), _RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a
    space) and the removed spans (source document and position, words, digest).

    Words are runs of anything but ASCII white space. Null and empty texts
    have none; texts shorter than a window lose nothing. A null id comes back
    null: such a row neither loses words nor takes them from others. Rows that
    repeat an id are judged each by its own words, and never against each
    other. Other columns of ``docs`` are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeats = repeated_edges(rows, window, sub)
    result = Stored(_covered(rows, repeats, window), "deduped").df

    spans = result.select(F.explode("spans").alias("s")).select("s.*")
    asked = spans.groupBy("src_doc").agg(F.collect_set(F.struct("src_pos", "n", "digest")).alias("asked"))
    checked = (rows.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("src_doc")).select("doc_id", "text", "asked")
               .mapInArrow(_verified, "src_doc long, src_pos long, n long, digest binary, same boolean"))
    failed = frozen(checked.groupBy("src_doc", "src_pos", "n", "digest").agg(F.max("same").alias("same")).filter("NOT same").drop("same"))
    if failed.isEmpty():
        return result
    # equal hashes of different words: take the sources of such spans back and cover those documents again
    hit = (result.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").join(failed, ["src_doc", "src_pos", "n", "digest"])
           .select(F.col("doc_id").alias("b_doc"), F.col("src_doc").alias("b_src"), F.col("src_pos").alias("b_from"), "n"))
    broken = hit.select(F.col("b_doc").alias("x_doc")).distinct()
    good = (repeats.join(broken, F.col("doc") == F.col("x_doc"), "left_semi").select("doc", F.explode("repeats").alias("r"))
            .join(hit, (F.col("doc") == F.col("b_doc")) & (F.col("r.src_doc") == F.col("b_src")) & (F.col("r.src_pos") >= F.col("b_from"))
                  & (F.col("r.src_pos") <= F.col("b_from") + F.col("n") - window), "left_anti")
            .groupBy("doc").agg(F.collect_list("r").alias("repeats")))
    again = _covered(rows.join(broken, F.col("doc_id") == F.col("x_doc"), "left_semi"), good, window)
    return result.join(broken, F.col("doc_id") == F.col("x_doc"), "left_anti").unionByName(again)
