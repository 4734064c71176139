"""Timeline view: day offsets, overlap-free lanes, peak concurrency, day axis
(A10, A11, A16, T1-T5).

Days are 24-hour blocks counted from the *instant* of the global minimum
(not calendar midnights), as in the reference chart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.scalars import preview
from feedlens.plans.ranking import prefix_sum_within

_DAY_US = 86400000000.0
GROUPS = ("status", "tier", "tag")


def group_key(group: str = "status"):
    """T5: the chosen column, else the tier, else ``unknown`` (empty counts as missing)."""
    tier = F.nullif(F.col("user_tier"), F.lit(""))
    if group == "tier" or group not in GROUPS:
        return F.coalesce(tier, F.lit("unknown"))
    return F.coalesce(F.nullif(F.col(group), F.lit("")), tier, F.lit("unknown"))


def _day_offset(ts, origin):
    return F.floor(F.timestamp_diff("MICROSECOND", origin, ts) / _DAY_US).cast("long")


def timeline_intervals(df: DataFrame, group: str = "status", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, group_key, start_day, end_day, duration) per row.

    The origin is the global minimum of ``coalesce(created_at, updated_at)``,
    a one-row scalar subquery. An update before creation gives duration 1;
    its end day is clamped to the start day so intervals stay well formed.
    ``keep`` carries more input columns along (no join back by id).
    """
    origin = df.select(F.min(F.coalesce("created_at", "updated_at"))).scalar()
    start = _day_offset(F.col("created_at"), origin)
    end = F.greatest(_day_offset(F.col("updated_at"), origin), start)
    return df.select("id", group_key(group).alias("group_key"), start.alias("start_day"), end.alias("end_day"),
                     (end - start + 1).alias("duration"), *keep)


def peak_concurrency(df: DataFrame, group: str = "status") -> DataFrame:
    """Items per group and the lanes the group needs = the largest
    number of items alive on one day (closed intervals).

    Sweep line: +1 on the start day, -1 the day after the end; summed per
    (group, day) with partial aggregation, then a running sum per group over
    *distinct days* (bounded by the span, not by rows).
    """
    iv = timeline_intervals(df, group)
    ev = iv.select("group_key", F.explode(F.array(
        F.struct(F.col("start_day").alias("day"), F.lit(1).alias("d"), F.lit(1).alias("item")),
        F.struct((F.col("end_day") + 1).alias("day"), F.lit(-1).alias("d"), F.lit(0).alias("item")))).alias("e"))
    per_day = ev.groupBy("group_key", F.col("e.day").alias("day")).agg(
        F.sum("e.d").alias("d"), F.sum("e.item").alias("items"))
    w = Window.partitionBy("group_key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = per_day.withColumn("alive", F.sum("d").over(w))
    return running.groupBy("group_key").agg(F.sum("items").cast("long").alias("items"),
                                            F.max("alive").cast("long").alias("lanes"))


def bar_labels(df: DataFrame, group: str = "status") -> DataFrame:
    """F16: the text of each timeline bar: ``#id`` and the first 20
    characters of the text; its tooltip: the first 100 characters (or
    ``No text``), the id and the status."""
    txt = F.coalesce(F.col("text"), F.lit(""))
    label = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), preview(txt, 20))
    tip = F.concat(F.coalesce(F.nullif(preview(txt, 100), F.lit("")), F.lit("No text")), F.lit(" (ID: "),
                   F.col("id").cast("string"), F.lit(", "), F.coalesce(F.col("status"), F.lit("null")), F.lit(")"))
    return df.select("id", group_key(group).alias("group_key"), label.alias("label"), tip.alias("tooltip"))


def date_spine(df: DataFrame) -> DataFrame:
    """T4: one row per day of the span: (day_index, date) from the first day."""
    t = F.coalesce(F.col("created_at"), F.col("updated_at"))
    span = df.agg(F.min(t).alias("min_ts"), F.max(t).alias("max_ts"))
    days = F.ceil(F.timestamp_diff("MICROSECOND", F.col("min_ts"), F.col("max_ts")) / _DAY_US) + 1
    return (span.select(F.to_date("min_ts").alias("d0"), F.explode(F.sequence(F.lit(0), (days - 1).cast("int"))).alias("day_index"))
            .select(F.col("day_index").cast("long").alias("day_index"), F.date_add("d0", F.col("day_index")).alias("date")))


# ---- T2: lane assignment --------------------------------------------------------
_RUN_SCHEMA = "group_key string, start_day long, end_day long, rank_lo long, lane_lo long, n long"
_FREE = -(1 << 62)  # end day of a lane that is free for every later start
BLOCK_ROWS = 256


def _pack_buckets(pdf: pd.DataFrame) -> pd.DataFrame:
    """First-fit packing of one island's buckets, lanes kept as runs.

    A bucket is ``c`` identical intervals [s, e]. In start order a lane is
    free for [s, e] iff its last interval ended before s; identical items
    take the lowest free lanes one after another, so a bucket takes the
    first ``c`` free lanes and opens new ones past the top if needed. Lane
    state is a list of runs (lo, hi, end); runs that ended before the current
    start are merged into free gaps, so the list grows with the lanes still
    alive, not with the number of items or of buckets seen.
    """
    pdf = pdf.sort_values(["start_day", "end_day"], kind="mergesort")
    runs: list[list[int]] = []  # [lo, hi_exclusive, end] sorted by lo, covering 0..top
    top = 0
    out = []
    gk = pdf["group_key"].iloc[0]
    for s, e, c in zip(pdf["start_day"].to_numpy(), pdf["end_day"].to_numpy(), pdf["c"].to_numpy()):
        s, e, need = int(s), int(e), int(c)
        # starts only grow: a lane that ended before s stays free, so its
        # end no longer matters - mark it free and merge free neighbours,
        # which keeps the run list as short as the lanes still alive
        compact: list[list[int]] = []
        for lo, hi, end in runs:
            end = _FREE if end < s else end
            if compact and compact[-1][2] == end and compact[-1][1] == lo:
                compact[-1][1] = hi
            else:
                compact.append([lo, hi, end])
        runs = compact
        rank = 0
        new_runs = []
        for lo, hi, end in runs:
            if need > 0 and end < s:
                take = min(need, hi - lo)
                out.append((gk, s, e, rank, lo, take))
                rank += take
                need -= take
                new_runs.append([lo, lo + take, e])
                if lo + take < hi:
                    new_runs.append([lo + take, hi, end])
            else:
                new_runs.append([lo, hi, end])
        if need > 0:
            out.append((gk, s, e, rank, top, need))
            new_runs.append([top, top + need, e])
            top += need
        # merge neighbours with the same end to keep the run list short
        merged: list[list[int]] = []
        for r in new_runs:
            if merged and merged[-1][2] == r[2] and merged[-1][1] == r[0]:
                merged[-1][1] = r[1]
            else:
                merged.append(r)
        runs = merged
    return pd.DataFrame(out, columns=["group_key", "start_day", "end_day", "rank_lo", "lane_lo", "n"])


def timeline_lanes(df: DataFrame, group: str = "status") -> DataFrame:
    """(id, group_key, start_day, end_day, duration, lane) with first-fit
    lanes in (start, duration) order; closed intervals, touching days overlap.

    1. items collapse to buckets (group, start, end) with counts - bounded by
       distinct day pairs, however many rows there are;
    2. buckets are cut into islands where a start passes every earlier end
       (all lanes are free there, so islands pack independently);
    3. each (group, island) is packed by ``applyInPandas`` into lane runs;
    4. items get a rank inside their bucket (updated_at desc, id desc) from
       the range-partitioned prefix count, and find their run through an
       equi-join on (bucket, rank block) with blocks of BLOCK_ROWS ranks: a
       hot bucket is many keys and the join fan-out is bounded.

    The lane count per group equals ``peak_concurrency``. Divergence from the
    reference on purpose: its loop sometimes opens an extra row for an item it
    already placed; this gives the evident intent (minimal first-fit lanes).
    """
    iv = timeline_intervals(df, group, keep=("updated_at",))  # tie order rides along: no self-join
    buckets = iv.groupBy("group_key", "start_day", "end_day").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("group_key").orderBy("start_day", "end_day")
    prev_end = F.max("end_day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isl = (buckets.withColumn("_new", F.when(prev_end.isNull() | (F.col("start_day") > prev_end), 1).otherwise(0))
           .withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new"))
    runs = isl.groupBy("group_key", "island").applyInPandas(
        lambda pdf: _pack_buckets(pdf), schema=_RUN_SCHEMA)
    # split runs at rank-block borders so the item join is an equi-join on
    # (bucket, block): a block is BLOCK_ROWS consecutive ranks, so a hot
    # bucket spreads over c / BLOCK_ROWS keys and an item meets at most
    # BLOCK_ROWS + 1 pieces (runs cover disjoint rank ranges)
    b = F.lit(BLOCK_ROWS)
    pieces = (runs.withColumn("blk", F.explode(F.sequence(F.floor(F.col("rank_lo") / b).cast("long"),
                                                          F.floor((F.col("rank_lo") + F.col("n") - 1) / b).cast("long"))))
              .select("group_key", "start_day", "end_day", "blk", "rank_lo", "lane_lo", "n"))
    ranked = prefix_sum_within(iv, ["group_key", "start_day", "end_day"],
                               [F.col("updated_at").desc_nulls_last(), F.col("id").desc()], None, "rank")
    ranked = ranked.withColumn("blk", F.floor(F.col("rank") / b).cast("long"))
    j = ranked.join(pieces, ["group_key", "start_day", "end_day", "blk"])
    j = j.where((F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_lo") + F.col("n")))
    return j.select("id", "group_key", "start_day", "end_day", (F.col("end_day") - F.col("start_day") + 1).alias("duration"),
                    (F.col("lane_lo") + F.col("rank") - F.col("rank_lo")).alias("lane"))
