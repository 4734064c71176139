import hashlib
import random

from feedlens.llm import substring

SCHEMA = "doc_id long, text string, spans int, doc int"


def brute(docs, window=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = b" ".join(w[k: k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[b" ".join(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA)
    return sorted([tuple(r)[:4] for r in substring.substring_dedup(df).drop("spans").collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "a\u00a0b", "X"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit%d" % i
            words += p[rng.randint(0, 3):] + [rng.choice(vocab) for _ in range(rng.randint(0, 9))]
        docs.append((i * 3 - 20, rng.choice([" ", "\n", "  \t"]).join(words)))
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert run(spark, docs) == brute(docs)


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, " \n "), (5, passage), (4, passage + " tail"), (None, passage), (None, passage),
            (9, passage), (9, passage + " other"), (9, passage), (7, "a " * 3000), (8, "a " * 2990 + "b")]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_spans_name_their_sources(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, "x y " + passage), (2, passage + " z")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substring.substring_dedup(df).collect()}
    assert got[1] == []
    assert [(s["src_doc"], s["src_pos"], s["n"]) for s in got[2]] == [(1, 2, 20)]


def test_deceived_hashes_are_taken_back(spark, monkeypatch):
    """A hash that tells no words apart: verification must keep what only looks repeated."""
    docs = [(1, " ".join(f"a{i}" for i in range(13))), (2, " ".join(f"b{i}" for i in range(13))), (3, " ".join(f"a{i}" for i in range(13)))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    h = substring.Words()
    edge, true = (int(substring.edges(substring._hashes(docs[k][1].encode().split(), h), 13).view("int64")[0]) for k in (1, 2))
    fake = spark.createDataFrame([(2, [(edge, 1, 0)]), (3, [(true, 1, 0)])],
                                 "doc long, repeats array<struct<edge:long,src_doc:long,src_pos:long>>")
    monkeypatch.setattr(substring, "repeated_edges", lambda *a: fake)
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(rows).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_hashes_of_runs():
    import numpy as np
    h = np.random.default_rng(0).integers(0, 2 ** 63, 40, dtype=np.uint64)
    base = int(substring._BASE)
    for k in range(1, 20):
        slow = np.array([sum(int(h[i + j]) * base ** (k - 1 - j) for j in range(k)) % 2 ** 64 for i in range(len(h) - k + 1)], dtype=np.uint64)
        assert (substring._runs(h.copy(), k) == substring._mixed(slow)).all(), k
    m = substring.minimizers(h, 13, 5)
    assert (m == [substring._runs(h, 5)[i: i + 9].min() for i in range(28)]).all()


def test_words_are_read_as_bytes():
    """Words are cut from a text's bytes as they are, at ASCII white space alone; the first of equal neighbours stays."""
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, 4]), pa.array(["a\x0bé x\x1cy\n", None, ""])], ["doc_id", "text"])
    assert list(substring._docs(batch)) == [(3, [b"a", "é".encode(), b"x\x1cy"]), (None, []), (4, [])]
    raw = pa.Array.from_buffers(pa.string(), 1, pa.array([b"\xff a"], pa.binary()).buffers())  # no UTF-8
    assert list(substring._docs(pa.RecordBatch.from_arrays([pa.array([1]), raw], ["doc_id", "text"]))) == [(1, [b"\xff", b"a"])]
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50):
        a, b = rng.integers(0, 2, (2, n))
        assert substring._first(a, b).tolist() == [i == 0 or (a[i], b[i]) != (a[i - 1], b[i - 1]) for i in range(n)]


def test_blocks_of_rows_are_cut_and_hashed_at_once(monkeypatch):
    """Words are cut and hashed for many rows together, none of them one by one but the long ones; a word's hash is its own wherever it stands."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    parts = ["a", "Ab", "é", "漢字", "w" * 7, "x" * 8, "y" * 9, "z" * 64, "v" * 65, "v" * 64 + "u", "\x1c", " ", "\0", " ", " ", " ", "\n", "\x0b ", "\t\t", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "  ", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["not this", *texts])], ["doc_id", "text"]).slice(1)
    every = sorted({w for t in texts for w in (t or "").encode().split()})
    missed = []
    monkeypatch.setattr(substring.Words, "__missing__", lambda self, word, found=substring.Words.__missing__: missed.append(word) or found(self, word))
    alone = {w: int(h) for w, h in zip(every, substring._hashes(every, substring.Words()))}
    assert len(set(alone.values())) == len(every)
    assert {len(w) > substring.LONG for w in missed} == {True}
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        seen = 0
        for rows, block in substring._blocks(batch):
            h, (joined, at) = block.hashes(substring.Words()), block.joined()
            owner = block.rows()
            starts = [int(i) for i in block.windows(3)]
            assert starts == [i for i in range(len(h) - 2) if owner[i] == owner[i + 2]]
            for k in range(rows.num_rows):
                words = (texts[seen] or "").encode().split()
                i, j = block.cuts[k], block.cuts[k + 1]
                assert [alone[w] for w in words] == h[i:j].tolist()
                assert joined[at[i]: at[j]].tobytes() == b"".join(w + b" " for w in words)
                seen += 1
        assert seen == len(texts)
    eights = [np.frombuffer(w, np.uint8) for w in (b"ab cd", b"abcd")]
    assert substring._hashed(eights[0], np.array([0, 3]), np.array([2, 5]), substring.Words()).tolist() == \
        substring._hashed(eights[1], np.array([0, 2]), np.array([2, 4]), substring.Words()).tolist()


def test_small_blocks_give_the_same_rows():
    """Rows that meet in one block, or don't, lose the same words."""
    import pyarrow as pa
    docs = sorted((i, t) for i, t in corpus(5) if t)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    before = substring.BLOCK_BYTES
    try:
        got = []
        for size in (1, 500, before):
            substring.BLOCK_BYTES = size
            m = pa.Table.from_batches(substring._minimizers(13, 5)(iter([batch])))
            first = {}
            for x, doc in zip(m["m"].to_pylist(), m["doc"].to_pylist()):
                first.setdefault(x, set()).add(doc)
            shared = [[x for x, d in first.items() if len(d) > 1 and i in d] for i, _ in docs]
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.list_(pa.int64()))], ["doc_id", "text", "buckets"])
            p = pa.Table.from_batches(substring._paths(13, 5)(iter([rows])))
            got.append((sorted(map(str, m.to_pylist())), sorted(map(str, p.to_pylist()))))
        assert got[0] == got[1] == got[2] and len(got[0][1]) > 20
    finally:
        substring.BLOCK_BYTES = before
