"""E6 ranked similarity: distributed per-task top-k vs brute-force cosine."""

import numpy as np

from feedlens.operators import enrich


def test_similar_texts_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(400, 8))
    queries = rng.normal(size=(5, 8))
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<double>").repartition(6)
    qdf = spark.createDataFrame([(100 + j, [float(x) for x in v]) for j, v in enumerate(queries)],
                                "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in enrich.similar_texts(cdf, qdf, k=7).collect()}
    cn = corpus / np.linalg.norm(corpus, axis=1)[:, None]
    for j, q in enumerate(queries):
        sc = cn @ (q / np.linalg.norm(q))
        order = sorted(range(len(sc)), key=lambda i: (-sc[i], i))[:7]
        assert [got[(100 + j, r)] for r in range(1, 8)] == order


def test_slices_and_blocks(spark, monkeypatch):
    """Several slices and blocks give what one gives."""
    rng = np.random.default_rng(1)
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 4)))], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(rng.normal(size=(17, 4)))], "query_id long, embedding array<double>")
    whole = sorted((r["query_id"], r["rank"], r["id"]) for r in enrich.similar_texts(cdf, qdf, k=3).collect())
    monkeypatch.setattr(enrich, "SLICE_ROWS", 25)
    monkeypatch.setattr(enrich, "QUERY_ROWS", 5)
    assert whole == sorted((r["query_id"], r["rank"], r["id"]) for r in enrich.similar_texts(cdf, qdf, k=3).collect())
    assert enrich.similar_texts(cdf.limit(0), qdf, k=3).collect() == [] == enrich.similar_texts(cdf, qdf.limit(0), k=3).collect()


def frame(spark, vectors, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<double>")


def brute(corpus, queries, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    s = unit(corpus) @ unit(queries).T
    return [[i for i in sorted(range(len(corpus)), key=lambda i: (-round(s[i, j], 12), i))[:k]] for j in range(len(queries))]


def test_clustered_vectors_skip_most_cells(spark):
    """Rows in tight clusters: a query visits few cells, and the result is that of looking everywhere."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    corpus = np.concatenate([c + rng.normal(scale=.02, size=(40, 16)) for c in centers] + [np.zeros((3, 16))])
    queries = np.concatenate([centers[:10] + rng.normal(scale=.02, size=(10, 16)), np.zeros((1, 16))])
    cdf, qdf = frame(spark, corpus), frame(spark, queries, name="query_id")
    got = {}
    for r in enrich.similar_texts(cdf, qdf, k=5, slice_rows=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = brute(corpus, queries, 5)
    assert [[i for _, i in sorted(got[j])] for j in range(len(queries))] == want
    cells = enrich.Cells(cdf.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    asked = frame(spark, queries[:10]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.lit(0).alias("block"))
    first = enrich.cells_to_visit(cells, asked.withColumn("kth", F.lit(-2.0)), True)
    assert first.count() == 10
    score = {r["query_id"]: r["score"] for r in enrich.similar_texts(cdf, qdf, k=5).where("rank = 5").collect()}
    kth = spark.createDataFrame([(j, score[j] - 1e-3) for j in range(10)], "k long, kth double")
    later = enrich.cells_to_visit(cells, asked.join(kth, asked["qid"] == kth["k"]).select("qid", "qv", "block", "kth"), False).count()
    every = 10 * len(cells.cells)
    assert len(cells.cells) > 20 and later + 10 < every / 4


def test_copies_nulls_and_zero_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(60, [0.0, 0.0]), (61, None), (None, [1.0, 1.0]), (62, [-1.0, 0.0]), (63, [0.0, 1.0])]
    cdf = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.1]), (4, None)], "query_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in enrich.similar_texts(cdf, qdf, k=3, slice_rows=7).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 1, 62), (3, 2, 63), (3, 3, 60)]


def test_factorised_similar_items(spark):
    """Points with and without filters against a plain loop; what is stored grows with points plus rows."""
    import random

    from feedlens.operators import library
    rng = random.Random(2)
    pick = lambda xs: rng.choice(xs)
    rows = [(i, pick(["a", "b", None, ""]), pick(["x", "y", None]), pick(["u", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, status string, tag string, user_tier string")
    s = library.SimilarItems(df, df.where("id % 3 = 0"))
    points = [r for r in rows if r[0] % 3 == 0]
    want = sorted((p[0], r[0]) for p in points for r in rows if all(not a or a == b for a, b in zip(p[1:], r[1:])))
    assert sorted(tuple(r) for r in s.pairs().collect()) == want
    assert {r["point_id"]: r["similar"] for r in s.points.collect()} == {p[0]: sum(1 for w in want if w[0] == p[0]) for p in points}
    assert any(r["point_class"] == "{}" for r in s.points.collect())
    assert s.rows.count() == len(rows) and s.points.count() == len(points) and s.links.count() <= (4 * 3 * 2) ** 2
    some = spark.createDataFrame([(0,), (3,)], "point_id long")
    assert sorted(tuple(r) for r in s.pairs(some).collect()) == [w for w in want if w[0] in (0, 3)]
    empty = library.SimilarItems(df.limit(0), df.limit(0))
    assert empty.pairs().collect() == [] == empty.points.collect()
