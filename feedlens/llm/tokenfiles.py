"""Token ids in binary files, each document compressed alone with a shared dictionary.

Writing: documents are range-partitioned by id, so that files and the documents
in them ascend by id. A task tokenizes its documents, serializes the ids of
each (16 bits an id where the vocabulary allows, else 32), compresses them as
one Zstandard frame with the shared dictionary and appends the frame to its
file; a file ends at ``FILE_BYTES``. The dictionary is trained beforehand on
the serialized ids of a bounded sample (``SAMPLE_DOCS`` documents, a window of
at most ``SAMPLE_IDS`` ids of each); it only serves compression.

File: header (magic, version, bytes an id, SHA-256 of the dictionary), frames,
index (id, place, size and tokens of each document), footer (place of the
index, documents, CRC-32 of the index, magic). Each attempt of a task writes
files of new names; the ``manifest`` table, committed by Spark, lists the files
of the attempts that count, with their id ranges and the number of ids before
them, so that a lost executor or a second attempt adds nothing. A document is
read alone: the manifest gives the file, its index the frame.

The folder must be one that driver and executors share and that
``pyarrow.fs.FileSystem.from_uri`` opens (file, hdfs, s3, gs, ...).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.plans.ranking import prefix_sum_within

MAGIC, VERSION = b"TOKIDZST", 1
HEADER = "<8sII32s"  # magic, version, bytes an id, SHA-256 of the dictionary
FOOTER = "<QQI8s"  # place of the index, documents, CRC-32 of the index, magic
INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
#: Compressed bytes after which a file ends; bytes of ids that leave a task at a time.
FILE_BYTES, BATCH_BYTES = 256 << 20, 8 << 20
#: Training sample and size of the dictionary.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 2000, 2048, 112 << 10
#: Distinct pieces of text whose ids a task remembers.
MEMO_PIECES = 1 << 19
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"

#: A place between a character that is no white space and a blank: no token of a byte-level BPE
#: with the usual pre-tokenization goes over it.
_CUT = r"(?<=\S)(?= )"
#: A piece of Latin letters, perhaps behind a blank and before ASCII signs: the letters with the blank, and the signs, are a word of the BPE each.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_PLAIN = f"( ?{_LATIN}+)([!-&(-/:-@\\[-`{{-~]*)"
#: Bytes of texts that are cut at a time; a longer text is cut alone.
BLOCK_BYTES = 8 << 20
#: Kinds of bytes: white space and what might be, Latin letters, signs and digits, the quote, other characters in ASCII, others beyond, blanks, line feeds.
_SPACE, _LETTER, _SIGN, _QUOTE, _OTHER, _BEYOND, _BLANK, _FEED = range(8)


def _kinds() -> np.ndarray:
    """Kind of each byte; letters beyond ASCII are found by pairs of bytes."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    out[9:14] = out[28:32] = _SPACE
    out[33:127] = _SIGN
    out[65:91] = out[97:123] = _LETTER
    out[[39, 32, 10]] = _QUOTE, _BLANK, _FEED
    out[128:] = _BEYOND
    return out


def _borders() -> np.ndarray:
    """True at 8 * kind + kind of neighbouring bytes that no token joins, whatever stands around them."""
    out = np.zeros((8, 8), dtype=bool)
    out[_LETTER, [_SIGN, _QUOTE]] = out[_SIGN, _LETTER] = True
    out[[_LETTER, _SIGN, _QUOTE, _OTHER], _BLANK] = True
    return out.ravel()


_KINDS, _BORDERS = _kinds(), _borders()


def cuts(text: np.ndarray) -> np.ndarray:
    """Where the pieces of a text of UTF-8 bytes, or of texts one behind the other, begin: at places that no token of a byte-level
    BPE with the usual pre-tokenization goes over. These are before a blank behind a character that is no white space, around a
    line feed between such characters, and between a Latin letter and an ASCII sign or digit (no contraction among them).
    Where texts meet no place need be found."""
    kind = _KINDS[text]
    lead = np.flatnonzero((text[:-1] >= 0xC3) & (text[:-1] <= 0xC9))
    low = text[lead + 1]
    lead = lead[np.where(text[lead] == 0xC3, (low != 0x97) & (low != 0xB7), (text[lead] != 0xC9) | (low < 0x90))]  # U+00C0 to U+024F but two signs
    kind[lead] = kind[lead + 1] = _LETTER

    def solid_before(at: np.ndarray) -> np.ndarray:
        """False where the character before may be white space."""
        one, two, three = (text[np.maximum(at - k, 0)] for k in (1, 2, 3))
        wide = (two == 0xC2) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
        return (kind[np.maximum(at - 1, 0)] < _BLANK) & (kind[np.maximum(at - 1, 0)] > _SPACE) & ~((one >= 0x80) & wide) & (at > 0)

    def solid_after(at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(text) - 1)
        wide = (text[after] == 0xC2) | (text[after] >= 0xE1) & (text[after] <= 0xE3)
        return (kind[after] < _BLANK) & (kind[after] > _SPACE) & ~wide & (at + 1 < len(text))

    border = np.zeros(len(text), dtype=bool)
    pair = kind[:-1] << 3
    pair |= kind[1:]
    border[1:] = _BORDERS[pair]
    beyond = np.flatnonzero(pair == (_BEYOND << 3 | _BLANK)) + 1
    border[beyond[solid_before(beyond)]] = True
    feed = np.flatnonzero(kind == _FEED)
    feed = feed[solid_before(feed) & solid_after(feed)]
    border[feed] = border[feed + 1] = True
    return border


def byte_alphabet() -> list[str]:
    """The letter that a byte-level BPE writes for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return [chr(b) if b in itself else chr(256 + others.index(b)) for b in range(256)]


def pieces(text: str) -> list[str]:
    """``text`` cut where no token crosses: before a blank that follows a character that is no white space."""
    return re.split(_CUT, text)


class _Pieces(dict):
    """Ids of pieces, found when first asked for and remembered."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self._find, self._missed = find, 0

    def __missing__(self, key: str) -> bytes:
        found = self._find(key)
        if len(self) < MEMO_PIECES:
            self[key] = found
        else:  # the frequent ones are in; begin anew when as many again have been missed
            self._missed += 1
            if self._missed >= MEMO_PIECES:
                self.clear()
                self._missed = 0
        return found


class Encoder:
    """Ids of texts, as little-endian bytes, by the ``tokenizers`` file ``path``.

    Where the file is a byte-level BPE whose pre-tokenization splits before
    blanks, many texts at a time are cut into pieces, and each different piece
    is looked up, so that a repeated word is encoded once; whole texts are
    encoded by any other file. Texts with one of the file's added tokens are
    cut before blanks only.
    """

    def __init__(self, path: str, end_id: int | None, by_piece: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        usual = (spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and spec["normalizer"] is None
                 and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"])
        self._added = [t["content"] for t in spec["added_tokens"]]
        own = any(re.fullmatch(_PLAIN, t) or " " in t for t in self._added)
        self._by_piece = usual and not own if by_piece is None else by_piece
        most = max(self._tok.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.width = 2 if most < 1 << 16 else 4
        self._kind, self._letters = "H" if self.width == 2 else "I", byte_alphabet()
        self._bpe, self._plain, self._packers = self._tok.model.tokenize, re.compile(_PLAIN), {}
        self._end = b"" if end_id is None else self._packed([int(end_id)])
        self._signs = _Pieces(self._word)
        self._parts, self._words = _Pieces(self._piece), _Pieces(self._piece)

    def _packed(self, ids: list[int]) -> bytes:
        n = len(ids)
        if n not in self._packers:
            self._packers[n] = struct.Struct(f"<{n}{self._kind}").pack
        return self._packers[n](*ids)

    def _word(self, word: str) -> bytes:
        """Ids of what the pre-tokenization leaves together."""
        written = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else "".join(map(self._letters.__getitem__, word.encode()))
        return self._packed([t.id for t in self._bpe(written)])

    def _piece(self, text: str) -> bytes:
        bare = text[1:] if text[0] == " " else text
        if bare.isascii() and bare.isalpha():  # most words
            return self._packed([t.id for t in self._bpe(text if bare is text else "\u0120" + bare)])
        plain = self._plain.fullmatch(text)
        if plain:
            letters, signs = plain.groups()
            return self._word(letters) + self._signs[signs] if signs else self._word(letters)
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return self._packed(self._tok.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none) and the end id."""
        return self.encode_column(pa.array(list(texts), pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Like ``encode``, of a column of texts."""
        if not self._by_piece:
            for t in texts.to_pylist():
                yield (self._whole(t) if t else b"") + self._end
            return
        texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        odd = np.zeros(len(texts), dtype=bool)
        for t in self._added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
            found = self._block(texts.buffers()[2], offsets[first:last + 1])
            for k in range(first, last):
                ids = next(found)
                yield b"".join(map(self._parts.__getitem__, pieces(texts[k].as_py()))) + self._end if odd[k] else ids
            first = last

    def _block(self, data: pa.Buffer, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of texts that stand one behind the other in ``data``, and the end id. Each different piece is looked up once."""
        start, end = int(offsets[0]), int(offsets[-1])
        if start == end:
            yield from [self._end] * (len(offsets) - 1)
            return
        border = cuts(np.frombuffer(data, dtype=np.uint8)[start:end])
        at = (offsets - start).astype(np.int32)
        border[at[:-1][at[:-1] < at[1:]]] = True
        begins = np.append(np.flatnonzero(border), end - start).astype(np.int32)
        found = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), data.slice(start, end - start)).dictionary_encode()
        ids = pa.array(map(self._words.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(found.indices)
        places = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.searchsorted(begins, at)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        for a, b in zip(places, places[1:]):
            yield bytes(raw[a:b]) + self._end


def _encoder(path: str, end_id: int | None) -> Encoder:
    """This Python worker's encoder: what it has read and remembered serves its next tasks."""
    held = sys.modules.setdefault("feedlens_worker_encoders", types.ModuleType("feedlens_worker_encoders")).__dict__
    key = f"{path} {end_id} {MEMO_PIECES}"
    if key not in held:
        held[key] = Encoder(path, end_id)
    return held[key]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri)) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of about ``size`` bytes; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _sample(docs: DataFrame, path: str, end_id: int | None) -> list[bytes]:
    """Serialized ids of a bounded sample: a window, at a place drawn by hash, of each sampled document."""
    n = docs.count()
    share = min(1.0, 2 * SAMPLE_DOCS / max(n, 1))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, end_id)
        for b in batches:
            out = []
            for ids in enc.encode_column(b.column("text")):
                most = SAMPLE_IDS * enc.width
                at = zlib.crc32(ids) % max(1, (len(ids) - most) // enc.width + 1) * enc.width
                out.append(ids[at:at + most])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    rows = docs.filter(drawn).select("text").limit(SAMPLE_DOCS).mapInArrow(windows, "ids binary")
    return [bytes(r[0]) for r in rows.collect()]


class _File:
    """A file being written; its name is new for each attempt."""

    def __init__(self, folder: str, width: int, digest: bytes, part: int, seq: int):
        self.part, self.seq, self.name = part, seq, f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bin"
        where, base = _open(folder)
        self._out = where.open_output_stream(f"{base}/{self.name}")
        self._out.write(struct.pack(HEADER, MAGIC, VERSION, width, digest))
        self.place, self._index = struct.calcsize(HEADER), []

    def add(self, doc_id: int | None, frame: bytes, n_tokens: int) -> None:
        self._out.write(frame)
        self._index.append((doc_id or 0, doc_id is None, self.place, len(frame), n_tokens))
        self.place += len(frame)

    def close(self) -> tuple:
        index = np.array(self._index, dtype=INDEX)
        raw = index.tobytes()
        self._out.write(raw)
        self._out.write(struct.pack(FOOTER, self.place, len(index), zlib.crc32(raw), MAGIC))
        self._out.close()
        ids = index["doc_id"][index["null_id"] == 0]
        return (self.part, self.seq, self.name, len(index), int(index["n_tokens"].sum()), int(ids.min()) if len(ids) else None,
                int(ids.max()) if len(ids) else None, len(ids) < len(index))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize ``docs`` and write them to ``folder``, a new one, in ascending id order.

    ``tokenizer`` is the path of a ``tokenizers`` file, the same on every
    executor; ``end_id`` is appended to each document. Null and empty texts
    have no ids but the end id. Rows with a null id come first; rows that
    repeat an id are all written, ordered by a hash of their text (their
    order among equal texts does not matter). An empty table gives an empty
    manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    where, base = _open(folder)
    where.create_dir(base, recursive=True)
    raw = train(_sample(rows, tokenizer, end_id))
    digest = hashlib.sha256(raw).digest()
    with where.open_output_stream(f"{base}/dictionary") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)  # at most DICT_BYTES

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = _encoder(tokenizer, end_id), zstandard.ZstdCompressor(dict_data=_dictionary(shared.value))
        part, seq, out, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_column(b.column("text"))):
                out = out or _File(folder, enc.width, digest, part, seq)
                out.add(doc_id, packer.compress(ids), len(ids) // enc.width)
                if out.place >= FILE_BYTES:
                    done.append(out.close())
                    out, seq = None, seq + 1
        if out:
            done.append(out.close())
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.mapInArrow(files, MANIFEST).write.parquet(f"{folder}/attempts")
    listed = spark.read.parquet(f"{folder}/attempts")
    prefix_sum_within(listed, [], ["part", "seq"], weight="n_tokens", out="start").write.parquet(f"{folder}/manifest")


class Reader:
    """One file: checks it, then gives documents by their index entry."""

    def __init__(self, folder: str, name: str, raw: bytes):
        where, base = _open(folder)
        self._f = where.open_input_file(f"{base}/{name}")
        magic, version, self.width, digest = struct.unpack(HEADER, self._at(0, struct.calcsize(HEADER)))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no token file of version {VERSION}")
        if digest != hashlib.sha256(raw).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        place, n, crc, end = struct.unpack(FOOTER, self._at(self._f.size() - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        index = self._at(place, n * INDEX.itemsize)
        if end != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"the index of {name} is damaged")
        self.index = np.frombuffer(index, dtype=INDEX)

    def _at(self, place: int, size: int) -> bytes:
        self._f.seek(place)
        return self._f.read(size)

    def ids(self, entry: np.void) -> bytes:
        """The ids of a document as little-endian unsigned 32-bit numbers."""
        raw = self._unpack.decompress(self._at(int(entry["offset"]), int(entry["size"])))
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def close(self) -> None:
        self._f.close()


def _documents(spark: SparkSession, folder: str, wanted: Callable[[np.ndarray, pa.RecordBatch, int], np.ndarray]):
    """mapInArrow function over manifest rows: (doc_id, start, n_tokens, ids) of the index entries that ``wanted`` picks."""
    where, base = _open(folder)
    with where.open_input_file(f"{base}/dictionary") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])

        rows, held = [], 0
        for b in batches:
            for i, (name, start) in enumerate(zip(b.column("file").to_pylist(), b.column("start").to_pylist())):
                r = Reader(folder, name, shared.value)
                before = start + np.cumsum(r.index["n_tokens"], dtype=np.int64) - r.index["n_tokens"].astype(np.int64)
                for k in wanted(r.index, b, i):
                    e = r.index[k]
                    rows.append((None if e["null_id"] else int(e["doc_id"]), int(before[k]), int(e["n_tokens"]), r.ids(e)))
                    held += len(rows[-1][3])
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                r.close()
        if rows:
            yield batch(rows)

    return read


SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
#: Tasks that read files; each takes its share of them one after another.
READ_TASKS = 4096


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document of ``folder``."""
    files = spark.read.parquet(f"{folder}/manifest")
    dealt = files.select("file", "start").repartition(max(1, min(READ_TASKS, files.count())))
    return dealt.mapInArrow(_documents(spark, folder, lambda index, b, i: np.arange(len(index))), SCHEMA)


def fetch(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Like ``read``, of the documents whose id is in ``ids`` alone (rows that repeat an id: all of them; null ids: none).

    Ids meet the files whose range holds them by an equi-join on ranges of
    ids, about two for each file; a task then reads the index of a file and
    the frames asked for. Many ids of one file come in groups, each of which
    reads the index anew.
    """
    files = spark.read.parquet(f"{folder}/manifest").select("file", "start", "first_id", "last_id").filter("first_id IS NOT NULL")
    asked = ids.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    n, low, high = files.agg(F.count(F.lit(1)), F.min("first_id"), F.max("last_id")).first()
    shift = max(0, ((high - low) // (2 * n)).bit_length()) if n else 0
    ranges = files.withColumn("r", F.explode(F.sequence(F.shiftright("first_id", shift), F.shiftright("last_id", shift))))
    met = asked.withColumn("a_r", F.shiftright("id", shift)).join(
        ranges, (F.col("a_r") == F.col("r")) & F.col("id").between(F.col("first_id"), F.col("last_id")))
    group = F.pmod(F.xxhash64("id"), F.lit(64))
    lists = met.groupBy("file", "start", group.alias("g")).agg(F.collect_list("id").alias("wanted"))

    def wanted(index: np.ndarray, b: pa.RecordBatch, i: int) -> np.ndarray:
        own = np.asarray(b.column("wanted")[i].as_py(), dtype=np.int64)
        return np.flatnonzero(np.isin(index["doc_id"], own) & (index["null_id"] == 0))

    return lists.select("file", "start", "wanted").mapInArrow(_documents(spark, folder, wanted), SCHEMA)
