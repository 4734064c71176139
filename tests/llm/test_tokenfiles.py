import random
import uuid
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedlens.llm import tokenfiles as tf
from feedlens.session import checkpoint_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, ids string"


def plain(rows):
    tok = Tokenizer.from_file(PATH)
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    return sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids)


def written(spark, rows, **kw):
    folder = f"{checkpoint_dir(spark)}/tok-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    tf.write(df, folder, PATH, end_id=2, **kw)
    return folder


def got(df):
    return [(r.doc_id is not None, r.doc_id or 0, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in df.collect()]


TEXTS = ["a", "", None, "  two  blanks ", "line\n next\n\n  more\t tab ", "it's we'll  o'clock's", "naïve — “quoted” 你好 мир ½²", " lead", "trail ",
         "  nbsp   em", "x<|endoftext|> y <|endoftext|>", "a\x1c b\x1f  c", "1234567 89,000.50", "é combining", "\r\n \r\n", "word " * 30000]


def test_round_trip_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (-5, "negative"), (1 << 40, "far")]
    folder = written(spark, rows)
    res = tf.read(spark, folder)
    assert sorted(got(res)) == plain(rows)
    out = sorted(res.select("start", "n_tokens", "doc_id").collect())
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out])[:-1])  # no gap, no overlap
    shown = [r.doc_id for r in out]
    assert shown == sorted(shown, key=lambda x: (x is not None, x or 0))


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Zebra", "'s", "'", "ll", "é", "你", "12", ".", "—", " ", "\x1d", "<|endoftext|>", "_", "́", "?", "!)", "AZ", "az ", "b\nC", "x.\nyz", "ßü", "×", "ŉǆ", "ª"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    whole, cut = tf.Encoder(PATH, 2, by_piece=False), tf.Encoder(PATH, 2)
    assert list(whole.encode(texts)) == list(cut.encode(texts))
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].tolist()
    assert list(whole.encode(docs)) == list(cut.encode(docs))
    other = tf.Encoder(public_tokenizers.path("word_bpe_49k.json"), None)  # lower-cases and drops white space: whole texts
    assert list(other.encode(["A b", None])) == [np.array(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(
        "A b", add_special_tokens=False).ids, "<u2").tobytes(), b""]
    assert all("".join(tf.pieces(t)) == t for t in texts if t)


def test_many_files_and_fetch(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_BYTES", 400)
    monkeypatch.setattr(tf, "MEMO_PIECES", 50)
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice(["ab", "cd", "ef", f"w{rng.randrange(900)}"]) for _ in range(rng.randrange(40)))) for i in range(500)]
    folder = written(spark, rows)
    assert spark.read.parquet(f"{folder}/manifest").count() > 10
    assert sorted(got(tf.read(spark, folder))) == plain(rows)
    asked = spark.createDataFrame([(3,), (300,), (301,), (1497,), (None,), (3,)], "doc_id long")
    assert sorted(got(tf.fetch(spark, folder, asked))) == plain([r for r in rows if r[0] in (3, 300, 1497)])
    whole = {r.doc_id: r for r in tf.read(spark, folder).collect()}
    for r in tf.fetch(spark, folder, asked).collect():
        assert r == whole[r.doc_id]


def test_empty_table_and_other_dictionary(spark, tmp_path):
    assert tf.read(spark, written(spark, [])).collect() == []
    folder = written(spark, [(1, "one two")])
    name = spark.read.parquet(f"{folder}/manifest").first().file
    with pytest.raises(ValueError, match="another dictionary"):
        tf.Reader(folder, name, b"not this one")


def test_shared_dictionary_helps_short_documents(spark):
    rng = random.Random(2)
    words = [f"syllable{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(3000)]
    enc = tf.Encoder(PATH, 2)
    ids = list(enc.encode(texts))
    raw = tf.train(ids[:1500], 16 << 10)
    import zstandard
    with_dict = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    alone = zstandard.ZstdCompressor()
    assert sum(len(with_dict.compress(x)) for x in ids[1500:]) < 0.7 * sum(len(alone.compress(x)) for x in ids[1500:])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from feedlens.llm import queries
    res = queries.op12_token_files(spark, "/root/testdata/sf0.001")
    assert [f.dataType.typeName() for f in res.schema.fields] == ["long"] * 4
    rows = sorted((True, r.doc_id, r.n_tokens, r.ids_crc32) for r in res.collect())
    assert rows == plain([(r.doc_id, r.text) for r in docs.select("doc_id", F.col("text")).collect()])


def test_words_are_encoded_once_whatever_ends_them(monkeypatch):
    """Line feeds and the stops and commas that end words don't make words anew; ids stay those of whole texts."""
    texts = ["zworda zwordb, zworda. zwordb\nzworda zwordb.\nzworda, zwordb", "zworda.\nzwordb zworda,\nzwordb zworda. zwordb,", "zwordb\n", "x\0.\n \0\ny z\0, \n"]
    enc, asked = tf.Encoder(PATH, 2), []
    bpe = enc._bpe
    monkeypatch.setattr(enc, "_bpe", lambda word: asked.append(word) or bpe(word))
    assert list(enc.encode(texts[:2])) == list(tf.Encoder(PATH, 2, by_piece=False).encode(texts[:2]))
    blank = chr(0x120)
    assert not [k for k in [*enc._words, *enc._parts] if k.count("zword") > 1]
    assert asked.count(blank + "zworda") == 1 and asked.count(blank + "zwordb") == 1 and len(asked) <= 7
    rng = random.Random(4)
    texts += ["".join(rng.choices("aé漢 C.,\n\t\0'0&", k=rng.randint(1, 20))) for _ in range(5000)]
    assert list(tf.Encoder(PATH, 2).encode(texts)) == list(tf.Encoder(PATH, 2, by_piece=False).encode(texts))


def test_a_column_is_cut_at_once_and_its_pieces_looked_up_once(monkeypatch):
    """Texts are cut from the column's bytes, at borders of the pre-tokenization alone, and a repeated piece costs no lookup."""
    import pyarrow as pa
    rng = random.Random(6)
    signs = ["a", "Zé", "ñ", "漢", "я", " ", " ", "  ", "\n", "\t", "\x1c", "\0", "'", "'s", ".", ",", "7", "²", "—", "×", "÷", "ɏ", "ɐ", "\U0001f600",
             "\u0085", " ", " ", " ", " ", " ", " ", "　", "​", "﻿", "᠎", "́"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 25))) for _ in range(4000)]
    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    for t in texts[:1000]:
        borders = {len(t[:a].encode()) for _, (a, b) in split(t)}
        assert set(np.flatnonzero(tf.cuts(np.frombuffer(t.encode(), np.uint8))).tolist()) <= borders, t
    shown = "one two, three.\ncafé (four) 5%"
    assert np.flatnonzero(tf.cuts(np.frombuffer(shown.encode(), np.uint8))).tolist() == [3, 7, 8, 14, 15, 16, 21, 23, 27, 28]

    monkeypatch.setattr(tf, "BLOCK_BYTES", 200)
    rows = texts + [None, "", "x<|endoftext|> y <|endoftext|>", "word " * 500, None]
    column = pa.array(["not this", *rows, "nor this"]).slice(1, len(rows))
    assert list(tf.Encoder(PATH, 2).encode_column(column)) == list(tf.Encoder(PATH, 2, by_piece=False).encode(rows))
    assert list(tf.Encoder(PATH, None).encode_column(pa.array([], pa.string()))) == []
    assert list(tf.Encoder(PATH, None).encode_column(pa.array([None, ""]))) == [b"", b""]

    monkeypatch.setattr(tf, "BLOCK_BYTES", 1 << 20)
    enc, asked = tf.Encoder(PATH, 2), []

    class Counted(tf._Pieces):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(enc, "_words", Counted(enc._piece))
    assert len(set(enc.encode(["zworda zwordb, zwordb\nzworda"] * 100))) == 1
    assert sorted(asked) == ["\n", " zwordb", ",", "zworda"]
