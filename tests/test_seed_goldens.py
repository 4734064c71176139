"""Goldens on the 35 seed rows (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlens.operators import distribution, enrich, library, rollups, timeline


def ids(df):
    return [r["id"] for r in df.collect()]


def test_tag_counts(seed):
    got = {r["tag"]: r["count"] for r in rollups.tag_counts(seed).collect()}
    assert got == {"Bug Report": 8, "Feature Request": 6, "Other": 2, "Performance": 5, "Praise": 10,
                   "Security": 3, "Urgent": 1}


def test_sentiment_counts_and_library_classes(seed):
    got = {r["sentiment_bucket"]: r["count"] for r in rollups.sentiment_counts(seed).collect()}
    assert got == {"negative": 16, "neutral": 8, "positive": 11}
    classes = {c: library.filter_feedback(seed, sentiment_class_=c).count() for c in ("negative", "neutral", "positive")}
    assert classes == {"negative": 15, "neutral": 10, "positive": 10}


def test_feedback_dates(seed):
    dates = [r["date"] for r in rollups.feedback_dates(seed).collect()]
    assert dates[0] == dt.date(2026, 1, 26) and dates[-1] == dt.date(2026, 1, 19) and len(dates) == 8
    per_day = [library.feedback_by_date(seed, str(d)).count() for d in sorted(dates)]
    assert per_day == [1, 2, 2, 4, 5, 6, 9, 6]


def test_feedback_by_date(seed):
    assert ids(library.feedback_by_date(seed, "2026-01-22")) == [17, 4, 9, 31]


def test_latest_feedback(seed):
    assert ids(library.latest_feedback(seed))[:10] == [27, 35, 21, 29, 16, 34, 25, 32, 13, 31]
    assert library.latest_analyzed(seed).count() == 0


def test_sort_keys(seed):
    assert ids(library.sort_feedback(seed, "positive_desc"))[:5] == [6, 27, 32, 16, 23]
    assert ids(library.sort_feedback(seed, "negative_desc"))[:5] == [3, 9, 18, 1, 7]
    assert ids(library.sort_feedback(seed, "created_asc"))[:3] == [1, 2, 28]
    assert ids(library.sort_feedback(seed, "nonsense")) == ids(library.sort_feedback(seed, "created_desc"))


def test_urgency_impact(seed):
    rows = library.urgency_impact(seed).collect()
    assert len(rows) == 35
    got = [(r["id"], r["urgency_score"], r["impact"]) for r in rows[:6]]
    assert got == [(3, .95, .9), (9, .92, .85), (18, .9, .8), (1, .9, .8), (7, .88, .75), (21, .85, .7)]


@pytest.mark.parametrize("q,expected", [
    ("api", [35, 18, 6, 12]), ("Webhook", [19, 25, 26, 31, 2]), ("_ate", [27, 35, 11, 22, 5]),
    ("50%", [7]), ("   ", []), ("API", [35, 18, 6, 12])])
def test_search(seed, q, expected):
    assert ids(library.search_text(seed, q)) == expected


def test_status_timeline(seed):
    got = {(str(r["date"])[-2:], r["status"]): r["count"] for r in rollups.status_timeline(seed).collect()}
    assert got == {("19", "To Do"): 1, ("20", "To Do"): 1, ("22", "To Do"): 1, ("23", "To Do"): 2,
                   ("24", "To Do"): 1, ("24", "done"): 2, ("25", "To Do"): 7, ("25", "done"): 2,
                   ("25", "in progress"): 1, ("25", "to be reviewed"): 1, ("26", "done"): 6,
                   ("26", "in progress"): 6, ("26", "to be reviewed"): 4}
    dense = rollups.status_timeline_dense(seed).collect()
    assert len(dense) == 28 and sum(r["count"] for r in dense) == 35
    wide = rollups.status_timeline_wide(seed).collect()
    assert len(wide) == 7 and sum(r["To Do"] for r in wide) == 13
    odd = seed.withColumn("status", F.when(F.col("id") == 1, F.lit("blocked")).when(F.col("id") == 2, F.lit(None)).otherwise(F.col("status")))
    wide = rollups.status_timeline_wide(odd)
    assert {"blocked", "null"} <= set(wide.columns) and sum(sum(r[1:]) for r in wide.collect()) == 35
    assert sum(r["count"] for r in rollups.status_timeline_dense(odd).collect()) == 35


def test_resolution_time(seed):
    got = [(r["tag"], r["avg_hours"], r["count"]) for r in rollups.resolution_time(seed).collect()]
    assert got == [("Security", 92, 2), ("Bug Report", 85, 5), ("Performance", 72, 3), ("Feature Request", 71, 1),
                   ("Other", 33, 2), ("Praise", 0, 10)]
    act = [r["tag"] for r in rollups.resolution_time(seed, actionable_only=True).collect()]
    assert act == ["Security", "Bug Report", "Performance", "Feature Request"]


def test_date_span(seed):
    r = rollups.date_span(seed).first()
    assert (r["min_ts"], r["max_ts"], r["days"]) == (dt.datetime(2026, 1, 19, 13), dt.datetime(2026, 1, 26, 16), 9)
    spine = timeline.date_spine(seed).collect()
    assert len(spine) == 9 and spine[0]["date"] == dt.date(2026, 1, 19)


def test_daily_digest_lines(seed):
    rows = enrich.digest_lines(seed, ["2026-01-20"]).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["1. [Bug Report] Backup restore procedure takes too long.",
                                         "2. [Feature Request] Request: webhook retries with exponential backoff."]
    prompts = enrich.digest_prompts(seed.where("DATE(created_at) = DATE '2026-01-20'")).first()
    assert prompts["prompt"].split("\n")[1].startswith("2. [Feature Request]") and prompts["count"] == 2


BOX = {
    "tier": {"business": (5, -0.9, -0.8, 0.15, 0.3, 0.88, -0.074), "developer": (6, -0.75, -0.65, -0.55, -0.5, 0.75, -0.383333),
             "enterprise": (6, -0.7, -0.65, 0.1, 0.2, 0.92, -0.021667), "free": (6, -0.8, -0.3, 0.87, 0.9, 0.95, 0.403333),
             "pro": (7, -0.6, 0.0, 0.2, 0.85, 0.9, 0.321429), "tester": (5, -0.85, -0.72, -0.7, -0.45, -0.2, -0.584)},
    "status": {"To Do": (13, -0.85, -0.65, -0.6, 0.15, 0.3, -0.307692), "done": (10, 0.75, 0.8, 0.88, 0.9, 0.95, 0.862),
               "in progress": (7, -0.75, -0.72, -0.7, 0.0, 0.1, -0.474286),
               "to be reviewed": (5, -0.9, -0.5, -0.45, -0.3, -0.2, -0.47)},
    "tag": {"Bug Report": (8, -0.85, -0.72, -0.6, -0.5, -0.45, -0.64625), "Feature Request": (6, 0.0, 0.0, 0.15, 0.2, 0.3, 0.125),
            "Other": (2, -0.3, -0.3, -0.2, -0.2, -0.2, -0.25), "Performance": (5, -0.75, -0.7, -0.65, -0.65, -0.6, -0.67),
            "Praise": (10, 0.75, 0.8, 0.88, 0.9, 0.95, 0.862), "Security": (3, -0.9, -0.9, 0.1, 0.2, 0.2, -0.2),
            "Urgent": (1, -0.8, -0.8, -0.8, -0.8, -0.8, -0.8)},
    "channel": {"discord": (3, -0.9, -0.9, 0.9, 0.9, 0.9, 0.3), "email": (9, -0.7, 0.0, 0.15, 0.2, 0.8, 0.055556),
                "github": (6, -0.85, -0.7, -0.5, 0.75, 0.95, -0.158333), "slack": (5, -0.8, -0.65, -0.3, 0.0, 0.92, -0.166),
                "support": (6, -0.8, -0.75, -0.65, -0.45, -0.2, -0.595), "twitter": (3, 0.1, 0.1, 0.85, 0.87, 0.87, 0.606667),
                "web": (3, -0.6, -0.6, 0.8, 0.88, 0.88, 0.36)},
}


@pytest.mark.parametrize("dim", list(BOX))
def test_boxplot(seed, dim):
    got = {r["dimension"]: (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"])
           for r in distribution.sentiment_boxplot(seed, dim).collect()}
    assert got == BOX[dim]


LANES = {
    "status": {"To Do": (13, 6), "done": (10, 4), "in progress": (7, 7), "to be reviewed": (5, 4)},
    "tier": {"business": (5, 3), "developer": (6, 5), "enterprise": (6, 4), "free": (6, 2), "pro": (7, 3), "tester": (5, 4)},
    "tag": {"Bug Report": (8, 6), "Feature Request": (6, 3), "Other": (2, 2), "Performance": (5, 5), "Praise": (10, 4),
            "Security": (3, 3), "Urgent": (1, 1)},
}


@pytest.mark.parametrize("group", list(LANES))
def test_peak_concurrency_and_lanes(seed, group):
    got = {r["group_key"]: (r["items"], r["lanes"]) for r in timeline.peak_concurrency(seed, group).collect()}
    assert got == LANES[group]
    lanes = timeline.timeline_lanes(seed, group).collect()
    assert len(lanes) == 35
    by_group = {}
    for r in lanes:
        by_group.setdefault(r["group_key"], []).append(r)
    for g, rows in by_group.items():
        assert max(r["lane"] for r in rows) + 1 == LANES[group][g][1]
        for a in rows:
            for b in rows:
                if a["id"] < b["id"] and a["lane"] == b["lane"]:
                    assert a["end_day"] < b["start_day"] or b["end_day"] < a["start_day"]


def test_visible_columns_as_shown(seed):
    odd = seed.where("id <= 3").withColumns({"user_tier": F.when(F.col("id") == 1, F.lit(None)).otherwise(F.lit("")), "channel": F.lit(None).cast("string"),
                                             "sentiment": F.when(F.col("id") == 1, F.lit(0.145)).when(F.col("id") == 2, F.lit(-0.4))})
    cols = ["id", "tier", "channel", "when", "sentiment", "actions"]
    got = {r["id"]: r for r in library.project_columns(odd, cols, {c: True for c in cols}, "created_asc").collect()}
    assert [got[i]["sentiment"] for i in (1, 2, 3)] == ["0.14", "-0.40", "N/A"]
    assert {r["tier"] for r in got.values()} == {"unknown"} and {r["channel"] for r in got.values()} == {"-"}
    assert all(len(r["when"]) == 16 for r in got.values())
    by_mood = library.project_columns(odd, cols, {c: True for c in cols}, "positive_desc").collect()
    assert sorted(r["when"] for r in by_mood) == ["-0.40", "0.14", "N/A"]
