import random

import numpy as np
import pytest
import xxhash

from feedlens.llm import simhash


def slow_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(docs, radius=4):
    fps = [slow_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i] = min(label[i], label[j])
    low = {}
    for (d, _), x in zip(docs, label):
        if d is not None:
            low[x] = min(low.get(x, d), d)
    return sorted([(d, f"{f:016x}", low.get(x)) for (d, _), f, x in zip(docs, fps, label)], key=str)


def corpus(n=50, seed=3):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            w = rng.choice(docs)[1].split(" ")
            w[rng.randrange(len(w))] = rng.choice("xyz")
            docs.append((i + 10, " ".join(w)))
        else:
            docs.append((i + 10, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 300)))))
    return docs


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, fingerprint string, component_id int")
    return sorted([tuple(r) for r in simhash.simhash_components(df).collect()], key=str)


def test_against_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == slow_components(docs)


def test_edge_cases(spark):
    docs = [(5, None), (3, ""), (4, " \t"), (None, "one two"), (None, "ONE two"), (8, "One Two"), (8, "One Two"), (9, "É\u00a0A b"), (None, "alone here now again x")]
    assert run(spark, docs) == slow_components(docs)
    assert run(spark, []) == []


def test_fingerprint_of_long_text():
    rng = random.Random(0)
    t = " ".join(f"T{rng.randrange(99)}" for _ in range(3000))
    assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    fps = np.r_[fps, fps[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)),
                fps[:150] ^ np.uint64(0b1111), fps[:50] ^ np.uint64(0xFF)]
    planes = simhash.bit_planes(fps)
    full = np.full(len(planes), np.uint64(0xFFFFFFFFFFFFFFFF))
    for q in fps[::37]:
        hits = simhash.within(np.full(len(planes), q), planes, full, radius)
        got = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel()[: len(fps)]
        assert (got == (np.bitwise_count(fps ^ q) <= radius)).all()


def test_large_buckets_are_compared_in_parts(spark):
    """A dense ball and a chain, with buckets cut into parts of 16 rows."""
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = {base}
    while len(fps) < 150:
        x = base
        for b in rng.sample(range(63), rng.randint(0, 4)):
            x ^= 1 << b
        fps.add(x)
    chain = rng.getrandbits(63)
    for b in range(0, 40, 4):
        chain ^= 0b1111 << b
        fps.add(chain)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(df, bucket_rows=16).collect()}
    label = {f: i for i, f in rows}
    for _ in range(30):
        for f in fps:
            label[f] = min(label[g] for g in fps if bin(f ^ g).count("1") <= 4)
    assert got == label


def test_one_per_component_keeps_columns(spark):
    docs = [(4, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (None, "z z z z z"), (None, "y q w e r t"), (7, None), (1, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, w_n int")
    got = sorted([(r["doc_id"], r["text"]) for r in simhash.one_per_component(df).collect()], key=str)
    assert got == sorted([(1, ""), (2, "A b c d e"), (None, "z z z z z"), (None, "y q w e r t")], key=str)
    assert simhash.one_per_component(df).columns == df.columns
    assert simhash.one_per_component(df.limit(0)).count() == 0
