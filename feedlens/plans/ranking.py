"""Skew-proof ordered numbering inside groups.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task;
when one group holds a third of the data that task is the whole job. The
helpers here give the same numbers with the work spread out:

1. range-partition on (group, order) and sort inside each partition: a hot
   group is cut into many contiguous slices;
2. stamp every row with its slice (partition id) and position in the slice,
   then freeze that with a reliable ``checkpoint`` in the shared checkpoint
   folder - both later uses read the same stamps, whatever the optimizer
   does to each branch and whichever tasks are retried;
3. per (slice, group): count/weight and first position - a small table of
   at most #slices + #groups rows; per group, prefix sums over its slices;
4. number = position inside the slice + offset of the slice.

Only step 1 moves the data; step 3's table is small (Spark broadcasts it
when its measured size allows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import checkpoint_dir, short_shuffles


def _sort_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stamped(df: DataFrame, group_cols: list[str], orders: list[Column], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + orders
    rp = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
          .withColumns({"_rk_pid": F.spark_partition_id(), "_rk_pos": F.monotonically_increasing_id()}))
    with short_shuffles(spark):
        return rp.checkpoint(eager=True)


def prefix_sum_within(df: DataFrame, group_cols: list[str], order_cols: list, weight=None,
                      out: str = "prefix", num_partitions: int | None = None,
                      count_out: str | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over the rows of the same group that come
    strictly before this row in ``order_cols`` (an exclusive prefix sum).

    With ``weight=None`` each row weighs 1 and ``out`` is the 0-based row
    number; ``order_cols`` must then be a total order (end with a unique key).
    ``count_out`` also adds the 0-based row number from the same pass.
    """
    orders = [_sort_col(c) for c in order_cols]
    src = df if weight is None else df.withColumn("_rk_w", _sort_col(weight).cast("long"))
    rp = _stamped(src, group_cols, orders, num_partitions)
    w = F.lit(1).cast("long") if weight is None else F.col("_rk_w")
    totals = rp.groupBy("_rk_pid", *group_cols).agg(F.sum(w).alias("_rk_tot"), F.min("_rk_pos").alias("_rk_first"),
                                                    F.count(F.lit(1)).alias("_rk_cnt"))
    off_w = Window.partitionBy(*group_cols).orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_rk_pid", "_rk_first", *[F.col(g).alias(f"_rk_g_{i}") for i, g in enumerate(group_cols)],
                         F.coalesce(F.sum("_rk_tot").over(off_w), F.lit(0)).alias("_rk_off"),
                         F.coalesce(F.sum("_rk_cnt").over(off_w), F.lit(0)).alias("_rk_coff"))
    if weight is None:
        local = rp
    else:
        lw = (Window.partitionBy("_rk_pid", *group_cols).orderBy("_rk_pos")
              .rowsBetween(Window.unboundedPreceding, -1))
        local = rp.withColumn("_rk_local", F.coalesce(F.sum("_rk_w").over(lw), F.lit(0)))
    conds = [local["_rk_pid"] == offs["_rk_pid"]] + [
        local[g].eqNullSafe(offs[f"_rk_g_{i}"]) for i, g in enumerate(group_cols)]
    j = local.join(offs, reduce(lambda a, b: a & b, conds), "inner")
    value = (F.col("_rk_pos") - F.col("_rk_first")) if weight is None else F.col("_rk_local")
    res = j.withColumn(out, value + F.col("_rk_off"))
    if count_out:
        res = res.withColumn(count_out, F.col("_rk_pos") - F.col("_rk_first") + F.col("_rk_coff"))
    drop = ["_rk_w", "_rk_local", "_rk_off", "_rk_coff", "_rk_first", "_rk_pos"] + [
        f"_rk_g_{i}" for i in range(len(group_cols))]
    return res.drop(offs["_rk_pid"]).drop(*drop).drop("_rk_pid")


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number inside each group, ordered by ``order_cols`` (total order)."""
    r = prefix_sum_within(df, group_cols, order_cols, None, f"_{out}_0", num_partitions)
    return r.withColumn(out, F.col(f"_{out}_0") + 1).drop(f"_{out}_0")
