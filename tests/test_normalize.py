"""Model-response normaliser cases (FIXTURES.md section 4) and scalar helpers."""

import math

import pytest
from pyspark.sql import functions as F

from feedlens.functions import analysis as A
from feedlens.functions import scalars as X

CASES = [
    ("not json", ("Other", 0.0, 0.2, "")),
    ('{"tag":"bug","sentiment":"0.4","urgency":0.9,"summary":"ok"}', ("Bug Report", 0.4, 0.9, "ok")),
    ('{"tag":null,"sentiment":null,"urgency":null}', ("Other", 0.0, 0.2, "")),
    ('{"sentiment":7,"urgency_score":-3}', ("Other", 1.0, 0.0, "")),
    ('{"tag":"Slow page","sentiment":"Infinity","urgency":"abc","summary":5}', ("Performance", 0.0, 0.2, "")),
    ('{"urgency":null,"urgency_score":null}', ("Other", 0.0, 0.0, "")),
    ('{"sentiment":"","urgency":true}', ("Other", 0.0, 1.0, "")),
    ('{"sentiment":"0x10","urgency":"1f"}', ("Other", 1.0, 0.2, "")),
    ("[]", ("Other", 0.0, 0.2, "")),
    (None, (None, None, None, None)),
    ('{"tag":"Author feedback","sentiment":" -0.25 ","urgency":"0b1","summary":"' + "x" * 200 + '"}',
     ("Security", -0.25, 1.0, "x" * 140)),
    ('{"tag":"please DEBUG","sentiment":false,"urgency":"1e-1"}', ("Bug Report", 0.0, 0.1, "")),
]


def test_normalize_cases(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw_response string")
    got = {r["i"]: (r["tag"], r["sentiment"], r["urgency_score"], r["summary"])
           for r in A.normalize_analysis(df).collect()}
    for i, (_, exp) in enumerate(CASES):
        assert got[i] == exp, CASES[i][0]


@pytest.mark.parametrize("raw,tag", [("URGENT", "Urgent"), ("feature", "Feature Request"), ("debug", "Bug Report"),
                                     ("I love it", "Praise"), ("author", "Security"), ("timeout", "Performance"),
                                     ("urgent feature", "Urgent"), ("", "Other"), (None, "Other")])
def test_normalize_tag(spark, raw, tag):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(A.normalize_tag("t")).first()[0] == tag


def test_scalars(spark):
    df = spark.createDataFrame([("  hi 　", " 42abc", -1.7, None, "hello")],
                               "s string, n string, x double, e string, w string")
    r = df.select(X.js_trim("s").alias("t"), X.parse_int("n").alias("p"), X.trunc_int("x").alias("ti"),
                  X.default_if_empty("e", F.lit(""), "web").alias("d"), X.capitalize_first("w").alias("c"),
                  X.sentiment_pct(F.lit(0.5)).alias("pct"), X.mood5(F.lit(-0.6)).alias("m5"),
                  X.mood3(F.lit(None).cast("double")).alias("m3"), X.fixed(F.lit(None).cast("double")).alias("f"),
                  X.stakeholder_group(F.lit("developer")).alias("g")).first()
    assert (r["t"], r["p"], r["ti"], r["d"], r["c"]) == ("hi", 42, -1, "web", "Hello")
    assert (r["pct"], r["m5"], r["m3"], r["f"], r["g"]) == (75, "very_negative", "unknown", "N/A", "Internal")
    b = spark.range(1).select(X.bubble_xyr(F.lit(0.5), F.lit(None).cast("double")).alias("b")).first()["b"]
    assert (b["x"], b["y"], b["r"]) == (50.0, 0.0, 8.0)
    assert math.isclose(spark.range(1).select(X.bubble_xyr(F.lit(0.1), F.lit(0.25))["r"]).first()[0], 4.0)


def test_today_and_previews(spark):
    import datetime as dt
    before = dt.datetime.now(dt.timezone.utc).date()
    r = spark.range(1).select(X.today_utc().alias("d"), X.utc_now().alias("t"),
                              X.preview(F.lit("Écran noir au démarrage"), 5).alias("p"),
                              X.preview(F.lit("ab"), 20).alias("q")).first()
    after = dt.datetime.now(dt.timezone.utc).date()
    assert before <= r["d"] <= after and r["t"].microsecond == 0
    assert (r["p"], r["q"]) == ("Écran", "ab")


@pytest.mark.parametrize("x, text", [(0.145, "0.14"), (1.005, "1.00"), (0.125, "0.13"), (-0.125, "-0.13"), (0.0, "0.00"), (-0.001, "-0.00"),
                                     (2.5, "2.50"), (0.995, "0.99"), (1.255, "1.25"), (8.345, "8.35"), (1234.565, "1234.57"), (-1.0, "-1.00")])
def test_to_fixed(spark, x, text):
    from decimal import ROUND_HALF_UP, Decimal
    assert text == str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) or x in (-0.001,)
    assert spark.range(1).select(X.fixed(F.lit(x)).alias("t")).first()["t"] == text
