"""New-feedback ingest (S3/P11): JSON types, JS trim and defaults."""

from feedlens.sources import ingest


def test_ingest_rules(spark):
    bodies = ['{"feedback":"  hi  "}', '{"feedback":5}', '{"feedback":"\\u3000 "}', "not json", "null",
              '{"feedback":"x","source":"","channel":0,"tier":"","user_tier":"pro","severity_hint":"high"}',
              '{"feedback":"y","source":7,"tier":"team lead"}']
    raw = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, value string")
    out = {r["i"]: r for r in ingest.ingest(raw).collect()}
    assert (out[0]["text"], out[0]["source"], out[0]["channel"], out[0]["user_tier"], out[0]["severity_hint"]) == \
        ("hi", "user", "web", "free", None)
    for i in (1, 2, 3, 4):
        assert out[i]["reject_reason"] == "Missing 'feedback' string in body" and out[i]["text"] is None
    assert (out[5]["source"], out[5]["channel"], out[5]["user_tier"], out[5]["severity_hint"]) == ("user", "web", "pro", "high")
    assert (out[6]["source"], out[6]["user_tier"]) == ("7", "team lead")
    assert ingest.accepted(ingest.ingest(raw)).count() == 3
    assert ingest.rejected(ingest.ingest(raw)).count() == 4


def test_javascript_json_rules(spark):
    """The last of repeated keys counts; String(object) and String(array) as in JavaScript."""
    raw = spark.createDataFrame([('{"feedback":"a","feedback":"b"}',), ('{"feedback":"x","source":{"x":1},"channel":["a",null,2]}',)], "value string")
    got = ingest.ingest(raw).collect()
    assert [r["text"] for r in got] == ["b", "x"]
    assert got[1]["source"] == "[object Object]" and got[1]["channel"] == "a,,2"
