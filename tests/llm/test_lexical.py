import math
import random
import re

import numpy as np
import pytest

from feedlens.llm import lexical as X

DOCS = "doc_id long, text string, q int, length string, tids string"
ITEMS = "item_id long, text string, rank int"
RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in RE.findall(text or "")]


def brute(docs, items, k):
    have = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_all = len(have), sum(len(t) for _, t in have)
    df = {}
    for _, t in have:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, t in have:
            m = 100 - 90 + 90 * len(t) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * t.count(x) // (1000 * t.count(x) + 8 * m))
                    for x in set(terms(text)) if x in t)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=3, **kw):
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS)
    res = X.rank(d, q, k, **kw)
    assert [(f.name, f.dataType.simpleString()) for f in res.schema.fields] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in res.collect()), key=str)


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    skewed = [1 / (i + 1) for i in range(words)]
    return rng, vocab, [(i, " ".join(rng.choices(vocab, skewed, k=rng.choice([1, 5, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(X, "BUCKET_ROWS", 16)
    rng, vocab, docs = corpus(1, 400)
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(20)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # a group of copies: ties
    items += [(50, docs[5][1]), (51, docs[17][1] + " " + docs[18][1])]
    n = sum(len(set(terms(t))) for _, t in items)
    assert run(spark, docs, items, 4, block_terms=n // blocks + 1) == brute(docs, items, 4)


def test_edge_cases(spark):
    docs = [(1, "Alpha beta-gamma"), (2, None), (3, ""), (4, "... !!"), (5, "ALPHA alpha Äpfel ä İ 你好"), (None, "beta beta"), (None, "beta beta"), (7, "beta beta"),
            (7, "other"), (7, "other"), (-3, "gamma_delta\x00alpha\x7fbeta"), (8, "long " * 50_000 + "beta")]
    items = [(1, "beta"), (1, "beta"), (1, "Other!"), (2, None), (3, "?"), (None, "äpfel Äpfel 你好"), (4, "unknown"), (5, "alpha beta gamma delta long"), (6, "")]
    assert run(spark, docs, items) == brute(docs, items, 3)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, "a b")], [(1, "a")]) == brute([(1, "a b")], [(1, "a")], 3)
    assert run(spark, [(2, None)], [(1, "a")]) == []


def test_buckets_and_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(2)
    n, v = 4000, 300
    weights = np.sort(rng.integers(0, 9000, v))[::-1].copy()
    rows = []
    for _ in range(n):
        t = np.unique(rng.choice(v, size=rng.integers(1, 40), p=np.arange(1, v + 1)[::1] / (v * (v + 1) / 2)))
        rows.append((t.astype(np.int32), rng.integers(1, 900_000, len(t))))
    length = np.array([np.sqrt((weights[t] * x.astype(float) ** 2).sum()) for t, x in rows])
    keep = np.flatnonzero(length > 0)
    order = keep[np.argsort(-length[keep], kind="stable")]
    queries = [X.Query(t, weights[t]) for t in (np.unique(rng.choice(v, size=8)).astype(np.int32) for _ in range(30))]
    queries = [q for q in queries if q.length]
    search = X.Search(queries, np.ones(len(queries), np.int64), 5)
    for at in range(0, len(order), 256):
        own = order[at:at + 256]
        sizes = [len(rows[i][0]) for i in own]
        search.add(X.Bucket(own.astype(np.int64), length[own], np.r_[0, np.cumsum(sizes)], np.concatenate([rows[i][0] for i in own]),
                            np.concatenate([rows[i][1] for i in own])))
    q, ids, s = search.result()
    for j, query in enumerate(queries):
        w = dict(zip(query.tids.tolist(), query.weights.tolist()))
        all_ = sorted((-sum(w.get(t, 0) * x for t, x in zip(rows[i][0].tolist(), rows[i][1].tolist())), i) for i in keep.tolist())
        want = [(i, -x) for x, i in all_[:5] if x < 0]
        assert sorted(zip(ids[q == j].tolist(), s[q == j].tolist())) == sorted(want)
    assert search.pruned > 0 and search.dropped > search.scored / 2
