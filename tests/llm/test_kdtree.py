import math
import random

import numpy as np

from feedlens.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        s = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


def run(spark, rows, every=5, k=3):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in kdtree.top_k(df, every, k).collect())


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree, "QUERY_BLOCK", 20)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one vector many times: ties
    assert run(spark, rows) == brute(rows, 5, 3)


def test_edge_cases(spark):
    rows = [(0, [0.5, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.25, 0.25]),
            (6, [0.1, 0.1]), (6, [0.1, 0.1]), (None, [1.0, 1.0]), (7, []), (10, []), (-5, [3.0e9, -2.0e9]), (8, [1.0, 2.0, 3.0]), (5, [0.25, 0.25])]
    assert run(spark, rows) == brute(rows, 5, 3)
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0])]) == []


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(0)
    points = rng.integers(-200, 200, (500, 6))
    tree = kdtree.Tree(points, 16)
    for (a, b), lo, hi in zip(tree.range, tree.lo, tree.hi):
        own = points[tree.order[a:b]]
        assert (own.min(axis=0) == lo).all() and (own.max(axis=0) == hi).all()
    assert sorted(tree.order) == list(range(500))
