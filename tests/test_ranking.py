"""Distributed prefix counts vs a pandas reference, with one hot group."""

import numpy as np
from pyspark.sql import functions as F

from feedlens.plans.ranking import prefix_sum_within, row_number_within


def test_row_numbers_with_hot_group(spark):
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", None], n))
    v = rng.integers(0, 50, n)
    pdf = [(int(i), None if x is None else str(x), int(y)) for i, x, y in zip(range(n), g, v)]
    df = spark.createDataFrame(pdf, "id long, g string, v long")
    got = {r["id"]: r["rn"] for r in row_number_within(df, ["g"], [F.col("v").desc(), "id"], "rn", 8).collect()}
    import pandas as pd
    p = pd.DataFrame(pdf, columns=["id", "g", "v"]).sort_values(["v", "id"], ascending=[False, True])
    p["rn"] = p.groupby(p["g"].fillna("\u0000"), sort=False).cumcount() + 1
    assert got == dict(zip(p["id"], p["rn"]))


def test_weighted_prefix(spark):
    rows = [("x", 1.0, 3), ("x", 2.0, 1), ("x", 5.0, 2), ("y", -1.0, 4), ("y", 0.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    got = {(r["g"], r["v"]): r["before"] for r in prefix_sum_within(df, ["g"], ["v"], "c", "before", 3).collect()}
    assert got == {("x", 1.0): 0, ("x", 2.0): 3, ("x", 5.0): 4, ("y", -1.0): 0, ("y", 0.0): 4}


def test_global_order(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = row_number_within(df, [], [F.col("k").desc(), "id"], "pos", 5).orderBy("pos").select("k").collect()
    assert [r["k"] for r in got] == sorted(range(1000), reverse=True)


def test_boxplot_matches_sorted_list_rule(spark):
    """A7 on random data with heavy duplicates and one hot key vs the
    dashboard's rule (element at index floor(n*p) of the sorted values)."""
    from feedlens.operators.distribution import sentiment_boxplot
    rng = np.random.default_rng(11)
    n = 5000
    tier = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", ""], n))
    val = np.round(rng.normal(0, 0.5, n), 2)
    rows = [(int(i), str(t), float(v)) for i, t, v in zip(range(n), tier, val)]
    df = spark.createDataFrame(rows, "id long, user_tier string, sentiment double")
    got = {r["dimension"]: r for r in sentiment_boxplot(df, "tier").collect()}
    groups = {}
    for _, t, v in rows:
        groups.setdefault(t or "unknown", []).append(v)
    assert set(got) == set(groups)
    for k, vals in groups.items():
        s = sorted(vals)
        m = len(s)
        r = got[k]
        assert (r["n"], r["min"], r["max"]) == (m, s[0], s[-1])
        assert (r["q1"], r["median"], r["q3"]) == (s[int(m * 0.25)], s[int(m * 0.5)], s[int(m * 0.75)])
        assert abs(r["mean"] - sum(vals) / m) < 1e-6


def test_weighted_prefix_with_row_numbers_hot_group(spark):
    rng = np.random.default_rng(11)
    n = 4000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b"], n))
    w = rng.integers(0, 100, n)
    pdf = [(int(i), str(x), int(y)) for i, x, y in zip(range(n), g, w)]
    df = spark.createDataFrame(pdf, "id long, g string, w long")
    res = prefix_sum_within(df, ["g"], [F.col("id").desc()], "w", "before", 7, count_out="rn0").collect()
    got = {r["id"]: (r["before"], r["rn0"]) for r in res}
    import pandas as pd
    p = pd.DataFrame(pdf, columns=["id", "g", "w"]).sort_values("id", ascending=False)
    p["before"] = p.groupby("g")["w"].cumsum() - p["w"]
    p["rn0"] = p.groupby("g").cumcount()
    assert got == {i: (b, r) for i, b, r in zip(p["id"], p["before"], p["rn0"])}


def test_magnitude_digit_never_falls(spark):
    import math
    import random
    from feedlens.operators.distribution import magnitude_digit
    rng = random.Random(3)
    vals = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e308, -1e308, math.inf, -math.inf, math.nan, 1.0, 2.0, math.nextafter(2, 0), -1.0, 0.5]
    vals += [rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308) for _ in range(3000)] + [math.nextafter(2.0 ** k, 0) for k in range(-1000, 1000, 7)] + [2.0 ** k for k in range(-1000, 1000, 7)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [(r["v"], r["d"]) for r in df.select("v", magnitude_digit(df["v"]).alias("d")).collect()]
    order = sorted(got, key=lambda x: (math.isnan(x[0]), x[0] if not math.isnan(x[0]) else 0))
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))
    assert all((d > 0) == (v > 0) or math.isnan(v) for v, d in got)


def test_boxplot_of_many_distinct_values_with_outliers(spark, monkeypatch):
    """Values far out, values close together, and a geometric series: the windows that are ordered stay small."""
    import random
    from pyspark.sql import functions as F
    from feedlens.operators import distribution as D
    rng = random.Random(9)
    groups = {"out": [rng.uniform(-1, 1) for _ in range(4000)] + [1e300, -1e300],
              "close": [1 + k * 2.0 ** -50 for k in range(3000)] + [1e18],
              "powers": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-900, 900) for _ in range(3000)],
              "few": [0.25, 0.5, 0.5, float("inf")], "one": [3.0] * 500}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "user_tier string, sentiment double").repartition(4)
    seen = []
    real = D.narrowed

    def spy(hist, sought, ordered=100):
        out = real(hist, sought, ordered)
        seen.extend(D._within(hist, out).groupBy("dimension", "name").count().collect())
        return out

    monkeypatch.setattr(D, "narrowed", spy)
    got = {r["dimension"]: r for r in D.sentiment_boxplot(df, "tier").collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(s), s[0], s[-1])
        assert [got[g][q] for q in D.QUANTILES] == [s[int(len(s) * p)] for p in D.QUANTILES.values()]
    assert len(seen) == 15 and max(r["count"] for r in seen) <= 100
