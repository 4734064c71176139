"""Daily digest prompts: a busy day is cut into bounded prompts, no line lost."""

import datetime as dt

from feedlens.operators import enrich


def _day(spark, n, text_len):
    t0 = dt.datetime(2026, 3, 1, 8)
    rows = [(i, "x" * text_len + f" #{i}", "Bug Report" if i % 3 else None, t0 + dt.timedelta(seconds=i))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, tag string, created_at timestamp_ntz")


def test_busy_day_is_chunked_without_losing_lines(spark):
    df = _day(spark, 300, 200)
    max_chars = 5000
    prompts = enrich.digest_prompts(df, max_chars).orderBy("chunk").collect()
    assert len(prompts) > 1 and sum(p["count"] for p in prompts) == 300
    lines = [ln for p in prompts for ln in p["prompt"].split("\n")]
    # newest first, numbered 1..n across chunks, in order
    assert [int(ln.split(".")[0]) for ln in lines] == list(range(1, 301))
    assert lines[0].endswith("#299") and lines[-1].endswith("#0")
    longest = max(len(ln) for ln in lines)
    assert all(len(p["prompt"]) <= max_chars + longest + 1 for p in prompts)


def test_one_row_per_date_and_one_call_per_prompt(spark):
    df = _day(spark, 300, 200)
    whole = enrich.daily_digest(df, enrich.LineCounter()).collect()
    n = spark.sparkContext.accumulator(0)

    class Calls(enrich.LineCounter):
        def write(self, date, prompt):
            n.add(1)
            return super().write(date, prompt)

    calls = Calls()
    dates = spark.createDataFrame([("2026-03-01",), ("2026-03-02",)], "date string")
    got = {str(r["date"]): r for r in enrich.daily_digest(df, calls, dates, max_chars=500).collect()}
    prompts = enrich.digest_prompts(df, 500).count()
    assert prompts > enrich.MERGE_PARTS and n.value == prompts
    assert len(whole) == 1 and got["2026-03-01"] == whole[0] and whole[0]["count"] == 300
    assert got["2026-03-02"]["summary"] == "No feedback received on 2026-03-02." and got["2026-03-02"]["count"] == 0
    assert len(got) == 2


def test_errors_become_the_summary(spark):
    class Broken(enrich.LineCounter):
        def merge(self, date, parts):
            raise RuntimeError("no merge")

    got = enrich.daily_digest(_day(spark, 50, 100), Broken(), max_chars=1000).collect()
    assert [(r["summary"], r["count"]) for r in got] == [("Error generating summary: no merge", 50)]
    quiet = enrich.daily_digest(_day(spark, 5, 10), Broken()).collect()
    assert quiet[0]["summary"].startswith("2026-03-01: 5 items")


def test_a_failing_text_costs_one_row(spark):
    def scorer(texts):
        if texts.str.contains("boom").any():
            raise ValueError("boom")
        return enrich.keyword_response_scorer(texts)

    df = spark.createDataFrame([(i, "boom" if i in (3, 7) else "a bug") for i in range(20)], "id long, text string").coalesce(1)
    got = {r["id"]: r["raw_response"] for r in enrich.classify(df, scorer).collect()}
    assert {i for i, r in got.items() if r is None} == {3, 7} and len(got) == 20


def test_long_tags_count_towards_the_bound(spark):
    t0 = dt.datetime(2026, 3, 2, 8)
    rows = [(i, "short text", "T" * 3000, t0 + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, tag string, created_at timestamp_ntz")
    max_chars = 10_000
    prompts = enrich.digest_prompts(df, max_chars).collect()
    longest = max(len(ln) for p in prompts for ln in p["prompt"].split("\n"))
    assert sum(p["count"] for p in prompts) == 40
    assert all(len(p["prompt"]) <= max_chars + longest for p in prompts)


def test_no_call_gets_more_parts_than_a_merge_takes(spark):
    """A day of more than 64 x 64 parts: three levels of merges, in order, one row in the end."""
    n = 64 * 64 + 200
    most, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Noting(enrich.Generator):
        def write(self, date, prompt):
            return prompt.split("#")[1]

        def merge(self, date, parts):
            calls.add(1)
            if len(parts) > enrich.MERGE_PARTS:
                most.add(1)
            return ",".join(parts)

    got = enrich.daily_digest(_day(spark, n, 100), Noting(), max_chars=1).collect()
    assert most.value == 0 and calls.value >= n // 64 + 2
    assert [r["count"] for r in got] == [n] and got[0]["summary"] == ",".join(str(i) for i in range(n - 1, -1, -1))


def test_lines_across_slices_days_and_batches(spark):
    """A hot day over many slices, other days beside it, null texts and tags, equal times: numbers and weights are those of a plain sort."""
    from feedlens import schema as S
    t0 = dt.datetime(2026, 3, 1)
    rows = [(i, None if i % 11 == 0 else "y" * (i % 7), None if i % 5 == 0 else "" if i % 5 == 1 else "T", t0 + dt.timedelta(hours=(i % 3) * 24 if i % 4 == 0 else 1))
            for i in range(900)] + [(2000, "no day", "T", None)]
    df = spark.createDataFrame(rows, "id long, text string, tag string, created_at timestamp_ntz").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no coalescing: as many slices as there can be
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(tuple(r) for r in enrich.digest_lines(df).collect())
        prompts = enrich.digest_prompts(df, 400).orderBy("date", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, days = [], {}
    for i, text, tag, t in sorted((r for r in rows if r[3]), key=lambda r: (r[3].date(), -r[3].timestamp(), -r[0])):
        d = days.setdefault(t.date(), [0, 0])
        label, body = tag or "Unknown", text or ""
        d[0] += 1
        want.append((t.date(), d[0], f"{d[0]}. [{label}] {body}", d[1]))
        d[1] += len(body) + len(label) + S.DIGEST_LINE_OVERHEAD
    assert got == sorted(want)
    for date in days:
        own = [p for p in prompts if p["date"] == date]
        assert [p["chunk"] for p in own] == list(range(len(own)))
        assert "\n".join(p["prompt"] for p in own) == "\n".join(w[2] for w in sorted(want) if w[0] == date)


def test_one_exchange_carries_text(spark):
    plan = enrich.digest_prompts(_day(spark, 50, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
