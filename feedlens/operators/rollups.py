"""Rollups over the current feedback snapshot.

All of them are hash aggregates with map-side partial aggregation, so a hot
key (one tag holding a third of the rows) is pre-combined in every task
before the shuffle and never lands whole on one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.scalars import (capitalize_first, day, hours_between, label_or, mood3, mood5, sentiment_bucket,
                                        stakeholder_group)
from feedlens.plans.ranking import row_number_within

# Dimension name -> column; anything else falls back to the tier column.
DIMENSIONS = {"tier": "user_tier", "status": "status", "tag": "tag", "channel": "channel"}


def dimension_column(dim: str) -> str:
    return DIMENSIONS.get(dim, "user_tier")


def tag_counts(df: DataFrame) -> DataFrame:
    """A1: rows per tag; rows without a tag are left out."""
    return (df.where(F.col("tag").isNotNull()).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("count")))


def sentiment_counts(df: DataFrame) -> DataFrame:
    """A2: rows per sentiment bucket (+-0.25 inclusive); null sentiment left out."""
    return (df.where(F.col("sentiment").isNotNull())
            .groupBy(sentiment_bucket("sentiment").alias("sentiment_bucket"))
            .agg(F.count(F.lit(1)).alias("count")))


def sentiment_chart(df: DataFrame) -> DataFrame:
    """A2 + F17: the sentiment bar chart: bucket counts labelled with the
    bucket name's first letter upper-cased (``Positive``)."""
    return sentiment_counts(df).select(capitalize_first("sentiment_bucket").alias("label"), "count")


def status_timeline(df: DataFrame) -> DataFrame:
    """A3: rows per (day of last update, current status), by date."""
    return (df.groupBy(day("updated_at").alias("date"), F.col("status"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("date", "status"))


def status_timeline_dense(df: DataFrame) -> DataFrame:
    """A3 on the full grid of observed dates x observed statuses (a
    null status is one); missing cells are 0. No calendar fill: only dates that
    occur.

    The statuses are numbered, each observed date is exploded over the numbers,
    and equi-joins turn the numbers into statuses and fetch the sparse counts.
    """
    counts = df.groupBy(day("updated_at").alias("date"), F.col("status")).agg(F.count(F.lit(1)).alias("count"))
    statuses = row_number_within(counts.select("status").distinct(), [], [F.col("status").asc_nulls_first()], "_n").select(
        F.col("status").alias("g_status"), F.col("_n").cast("long").alias("_n"))
    k = statuses.select(F.max("_n")).scalar()
    grid = (counts.select(F.col("date").alias("g_date")).distinct()
            .select("g_date", F.explode(F.sequence(F.lit(1).cast("long"), k)).alias("_i"))
            .join(statuses, F.col("_i") == F.col("_n")).select("g_date", "g_status"))
    cells = counts.select(F.col("date").alias("c_date"), F.col("status").alias("c_status"), F.col("count").alias("c_count"))
    return (grid.join(cells, grid["g_date"].eqNullSafe(cells["c_date"]) & grid["g_status"].eqNullSafe(cells["c_status"]), "left")
            .select(F.col("g_date").alias("date"), F.col("g_status").alias("status"),
                    F.coalesce(F.col("c_count"), F.lit(0)).cast("long").alias("count"))
            .orderBy("date", "status"))


def status_timeline_wide(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """A4 wide form: one row per observed date, one column per status (0 if none).

    The columns are the observed statuses, a null status as ``null``, unless
    ``statuses`` names the ones wanted. More statuses than
    ``spark.sql.pivotMaxValues`` raise an error; take the dense form then."""
    dated = df.select(day("updated_at").alias("date"), F.coalesce("status", F.lit("null")).alias("status"))
    pivoted = dated.groupBy("date").pivot("status", statuses).agg(F.count(F.lit(1)))
    return pivoted.fillna(0, subset=pivoted.columns[1:]).orderBy("date")


def sentiment_by_tier(df: DataFrame) -> DataFrame:
    """A5: every non-null sentiment with its tier, sorted; a null tier is kept
    as its own group (the reference shows it under the key "null"). The id ends
    the sort key, so a range of equal sentiments can be cut between tasks."""
    return (df.where(F.col("sentiment").isNotNull())
            .orderBy("user_tier", "sentiment", "id").select("user_tier", "sentiment"))


def sentiment_by_dimension(df: DataFrame, dim: str = "tier") -> DataFrame:
    """Sentiment values per dimension value (tier/status/tag/channel,
    unknown name -> tier); null keys dropped, empty key -> "unknown"."""
    c = dimension_column(dim)
    return (df.where(F.col(c).isNotNull() & F.col("sentiment").isNotNull())
            .select(label_or(c, "unknown").alias("dimension"), "sentiment", "id")
            .orderBy("dimension", "sentiment", "id").drop("id"))


def sentiment_values_compact(df: DataFrame, dim: str = "tier") -> DataFrame:
    """A6, bounded form: (dimension, sentiment, n) - the sorted value lists as a
    histogram; exact, and its size is the number of distinct values."""
    c = dimension_column(dim)
    return (df.where(F.col(c).isNotNull() & F.col("sentiment").isNotNull())
            .groupBy(label_or(c, "unknown").alias("dimension"), "sentiment")
            .agg(F.count(F.lit(1)).alias("n")))


def resolution_time(df: DataFrame, actionable_only: bool = False, status: str | None = None) -> DataFrame:
    """Per tag, average whole hours from creation to last update (each
    row's hours truncated, the average truncated again) over edited rows
    (``updated_at <> created_at``), any status unless ``status`` is given."""
    f = (F.col("tag").isNotNull() & F.col("updated_at").isNotNull() & F.col("created_at").isNotNull()
         & (F.col("updated_at") != F.col("created_at")))
    if actionable_only:
        f = f & F.col("tag").isin(*S.ACTIONABLE_TAGS)
    if status is not None:
        f = f & (F.col("status") == status)
    return (df.where(f).groupBy("tag")
            .agg(F.avg(hours_between("created_at", "updated_at")).alias("_avg"), F.count(F.lit(1)).alias("count"))
            .select("tag", F.col("_avg").try_cast("int").alias("avg_hours"), "count")
            .orderBy(F.desc("avg_hours"), "tag"))


def feedback_dates(df: DataFrame, limit: int = S.DATES_LIMIT) -> DataFrame:
    """The newest distinct creation dates. Distinct is a partial
    aggregate; the final top-k is TakeOrderedAndProject."""
    return (df.select(day("created_at").alias("date")).distinct()
            .orderBy(F.desc_nulls_last("date")).limit(limit))


def date_span(df: DataFrame) -> DataFrame:
    """A10: global time span: first and last instant and the day count
    ``ceil((max-min)/1 day) + 1``. One global aggregate (partial per task)."""
    t = F.coalesce(F.col("created_at"), F.col("updated_at"))
    agg = df.agg(F.min(t).alias("min_ts"), F.max(t).alias("max_ts"))
    micros = F.timestamp_diff("MICROSECOND", F.col("min_ts"), F.col("max_ts"))
    return agg.select("min_ts", "max_ts", (F.ceil(micros / 86400000000.0) + 1).cast("long").alias("days"))


def summary_counts(df: DataFrame) -> DataFrame:
    """A15 (long form): tag counts and sentiment-bucket counts from ONE scan
    via grouping sets; rows with a null key in their own set are dropped."""
    bucket = F.when(F.col("sentiment").isNotNull(), sentiment_bucket("sentiment"))
    g = (df.select("tag", bucket.alias("bucket"))
         .groupingSets([["tag"], ["bucket"]], "tag", "bucket")
         .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")))
    # grouping_id bit order follows the grouping columns: tag set -> 1, bucket set -> 2
    return (g.where(((F.col("_gid") == 1) & F.col("tag").isNotNull()) | ((F.col("_gid") == 2) & F.col("bucket").isNotNull()))
            .select(F.when(F.col("_gid") == 1, F.lit("tag")).otherwise(F.lit("sentiment")).alias("section"),
                    F.coalesce("tag", "bucket").alias("key"), "count"))


def stakeholder_rollup(df: DataFrame) -> DataFrame:
    """P13 rollup: rows and mean sentiment per stakeholder group and tier."""
    return (df.groupBy(stakeholder_group("user_tier").alias("stakeholder"), label_or("user_tier", "unknown").alias("tier"))
            .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("sentiment"), 6).alias("mean_sentiment")))


def mood_bands(df: DataFrame) -> DataFrame:
    """F18/F19 rollup: rows per colour band and per five-level mood."""
    return (df.groupBy(mood3("sentiment").alias("band"),
                       F.when(F.col("sentiment").isNull(), F.lit("unknown")).otherwise(mood5("sentiment")).alias("mood"))
            .agg(F.count(F.lit(1)).alias("count")))
