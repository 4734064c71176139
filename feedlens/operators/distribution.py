"""Exact box-plot statistics per dimension value.

The quantile rule is the dashboard's: sort the n values of a group, take the
element at 0-based index floor(n*p) for p in (0.25, 0.5, 0.75). This is not
``percentile_disc`` (which takes index ceil(n*p)-1), so it is computed from
ranks, without collecting any group:

* histogram ``(key, value) -> count`` - a partial aggregate, so duplicates
  (the usual case: sentiment has two decimals) collapse before the shuffle
  and a hot key never reaches one task whole;
* radix selection: where a key has more than ``ORDERED`` distinct values, these
  are counted per digit, running sums over the digits tell which one holds
  the element, and only its values go on to the next pass. The first digit is
  sign and power of two, the others cut what is left of the range into ``BINS``
  equal parts, so a pass settles ten bits of the value whatever the outliers
  are, and six passes settle a double;
* the values that are left, at most ``ORDERED`` per element sought, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.scalars import label_or
from feedlens.operators.rollups import dimension_column
from feedlens.session import frozen

BINS, ORDERED = 1024, 8192
QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_LAST = 5000  # above the digit of any finite double


def magnitude_digit(v: Column) -> Column:
    """Sign and power of two of a double as a whole number that never falls where the value rises; infinities and NaN at the ends."""
    size = F.abs(v)
    # 2 ** -1074 is the smallest double: its digit is still above that of zero
    power = F.when(size == float("inf"), F.lit(_LAST - 1)).otherwise(F.floor(F.log2(size)).cast("int") + 1100)
    return F.when(F.isnan(v), F.lit(_LAST)).when(v > 0, power).when(v < 0, -power).otherwise(F.lit(0)).cast("int")


def _digit(first: bool) -> Column:
    if first:
        return magnitude_digit(F.col("v"))
    part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
    return F.when(F.col("hi") > F.col("lo"), F.least(part, F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _within(hist: DataFrame, sought: DataFrame) -> DataFrame:
    """The values (with counts) among which each element of ``sought`` still is. Both sides are written tables, so a hot dimension's join can be split."""
    s = sought.withColumnRenamed("dimension", "s_dimension")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return hist.join(s, (F.col("dimension") == F.col("s_dimension")) & inside).drop("s_dimension")


def narrowed(hist: DataFrame, sought: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """``sought`` (dimension, name, left, lo, hi, values: the element at 0-based index ``left`` among the values from lo
    to hi, so many distinct) narrowed by passes over digits until ``values`` is at most ``ordered``."""
    first = True
    while (sought.agg(F.max("values")).first()[0] or 0) > ordered:
        # those that are narrow enough go through unchanged: a digit for all their values
        small = F.col("values") <= ordered
        digits = (_within(hist, sought).withColumn("digit", F.when(small, F.lit(0)).otherwise(_digit(first)))
                  .groupBy("dimension", "name", "left", "digit")
                  .agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("values")))
        before = F.sum("c").over(Window.partitionBy("dimension", "name").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
        sought = frozen(digits.withColumn("before", F.coalesce(before, F.lit(0)))
                        .where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
                        .select("dimension", "name", (F.col("left") - F.col("before")).alias("left"), "lo", "hi", "values"))
        first = False
    return sought


def sentiment_boxplot(df: DataFrame, dim: str = "tier", value: str = "sentiment") -> DataFrame:
    """(dimension, n, min, q1, median, q3, max, mean) per dimension value.

    Same row filter as A6 (null key and null value dropped, "" -> unknown).
    ``mean`` is rounded to 6 decimals (summation order is not defined).
    """
    c = dimension_column(dim)
    base = (df.where(F.col(c).isNotNull() & F.col(value).isNotNull())
            .select(label_or(c, "unknown").alias("dimension"), F.col(value).cast("double").alias("v")))
    hist = frozen(base.groupBy("dimension", "v").agg(F.count(F.lit(1)).alias("c")))
    stats = hist.groupBy("dimension").agg(
        F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("values"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * p).alias("left")) for name, p in QUANTILES.items()])
    sought = stats.select("dimension", F.explode(ranks).alias("q"), F.col("min").alias("lo"), F.col("max").alias("hi"), "values")
    sought = narrowed(hist, sought.select("dimension", "q.name", "q.left", "lo", "hi", "values"))
    values = _within(hist, sought)
    values = values.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("dimension", "name").orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)))
    hit = values.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
    q = hit.groupBy("dimension").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in QUANTILES])
    return (stats.join(q, "dimension")
            .select("dimension", F.col("n").cast("long").alias("n"), "min", "q1", "median", "q3", "max", "mean")
            .orderBy("dimension"))
