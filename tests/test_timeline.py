"""Lane assignment against a brute-force item-by-item first-fit replay."""

from conftest import SF_MID
from feedlens.operators import timeline
from feedlens.sources.feedback import feedback_from_tables


def first_fit(items):
    """items: (id, start, end, updated_key) - replay in (start, duration, updated desc, id desc) order."""
    order = sorted(items, key=lambda t: (t[1], t[2] - t[1], -t[3], -t[0]))
    lane_end, out = [], {}
    for i, s, e, _ in order:
        for k, end in enumerate(lane_end):
            if end < s:
                lane_end[k] = e
                out[i] = k
                break
        else:
            lane_end.append(e)
            out[i] = len(lane_end) - 1
    return out


def test_lanes_equal_replay(spark):
    fb = feedback_from_tables(spark, SF_MID, with_text=False)
    lanes = timeline.timeline_lanes(fb, "tier").toPandas()
    iv = timeline.timeline_intervals(fb, "tier").join(fb.select("id", "updated_at"), "id").toPandas()
    iv["u"] = iv["updated_at"].astype("int64")
    got = dict(zip(lanes["id"], lanes["lane"]))
    peak = {r["group_key"]: r["lanes"] for r in timeline.peak_concurrency(fb, "tier").collect()}
    assert len(got) == len(iv)
    for g, sub in iv.groupby("group_key"):
        exp = first_fit(list(zip(sub["id"], sub["start_day"], sub["end_day"], sub["u"])))
        assert {i: got[i] for i in exp} == exp
        assert max(exp.values()) + 1 == peak[g]


def test_lanes_with_hot_bucket_equal_replay(spark):
    import datetime as dt
    import random
    rnd = random.Random(5)
    t0 = dt.datetime(2026, 2, 1)
    rows = []
    for i in range(2500):
        if i < 1500:  # one bucket with most of the rows: same group, same days
            s, e = 3, 5
        else:
            s = rnd.randrange(0, 10)
            e = s + rnd.randrange(0, 4)
        created = t0 + dt.timedelta(days=s, hours=1)
        updated = t0 + dt.timedelta(days=e, hours=1, seconds=rnd.randrange(0, 100))
        rows.append((i, "hot" if i < 1500 or i % 2 else "cold", "free", created, updated))
    fb = spark.createDataFrame(rows, "id long, status string, user_tier string, created_at timestamp_ntz, "
                                     "updated_at timestamp_ntz")
    lanes = timeline.timeline_lanes(fb, "status").toPandas()
    iv = timeline.timeline_intervals(fb, "status").join(fb.select("id", "updated_at"), "id").toPandas()
    iv["u"] = iv["updated_at"].astype("int64")
    got = dict(zip(lanes["id"], lanes["lane"]))
    assert len(got) == len(iv) == 2500
    for g, sub in iv.groupby("group_key"):
        exp = first_fit(list(zip(sub["id"], sub["start_day"], sub["end_day"], sub["u"])))
        assert {i: got[i] for i in exp} == exp


def test_bucket_packer_equals_item_replay():
    import random
    import pandas as pd
    rnd = random.Random(13)
    for _ in range(30):
        rows = {}
        for _ in range(rnd.randrange(1, 60)):
            s = rnd.randrange(0, 25)
            e = s + rnd.randrange(0, 6)
            rows[(s, e)] = rows.get((s, e), 0) + rnd.randrange(1, 9)
        pdf = pd.DataFrame([("g", s, e, c) for (s, e), c in rows.items()],
                           columns=["group_key", "start_day", "end_day", "c"])
        runs = timeline._pack_buckets(pdf)
        got = {}
        for r in runs.itertuples():
            for k in range(r.n):
                got[(r.start_day, r.end_day, r.rank_lo + k)] = r.lane_lo + k
        items = [(i, s, e, -k) for i, ((s, e), k) in enumerate(
            ((se, k) for se, c in sorted(rows.items()) for k in range(c)))]
        exp = first_fit(items)
        want = {}
        for i, s, e, negk in items:
            want[(s, e, -negk)] = exp[i]
        assert got == want
