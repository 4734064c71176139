"""Sharding by extendible hashing.

A document's hash is 60 bits of an MD5. A bucket of the directory is a prefix
of bits; only a bucket whose documents exceed the byte limit splits on one
more bit, until every shard fits. Byte counts are gathered once at a depth a
few bits finer than the average shard (the cells of the directory), summed up
to all shorter prefixes, and a shard is the shortest prefix that fits. Cells
that are still too large are counted again, alone, some bits deeper. The
directory is a table joined by cell; the driver only sees counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen, put_back, set_aside
from feedlens.plans.ranking import row_number_within

HASH_BITS = 60
#: Cells are so many bits deeper than the average shard, and deeper again for each further round.
CELL_BITS = 4
#: Helper columns begin so.
_HELPERS = ("_sh_", "_b_")


def doc_hash(id_col: str, text_col: str) -> Column:
    """60 bits of md5(id ':' md5(text)); a null id or text counts as empty."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def _prefix(h, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(cell -> depth of its shard, cells that are too large at ``high``).

    Buckets of depth ``low`` to ``high`` are sums of cells; a bucket is a
    shard if it fits (or holds a single hash, which no bit can split) and its
    parent does not.
    """
    level = cells.withColumn("_sh_d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    level = level.withColumn("_sh_p", F.expr(f"shiftright(_sh_cell, {high} - _sh_d)"))
    buckets = level.groupBy("_sh_d", "_sh_p").agg(
        F.sum("_sh_bytes").alias("_sh_sum"), F.min("_sh_min").alias("_sh_lo"), F.max("_sh_max").alias("_sh_hi"))
    fits = buckets.filter((F.col("_sh_sum") <= limit) | (F.col("_sh_lo") == F.col("_sh_hi"))).select(
        F.col("_sh_d").alias("_b_d"), F.col("_sh_p").alias("_b_p"),
        ((F.col("_sh_sum") > limit) & (F.col("_sh_lo") == F.col("_sh_hi"))).alias("_b_over"))
    found = (level.join(fits, (F.col("_sh_d") == F.col("_b_d")) & (F.col("_sh_p") == F.col("_b_p")), "left")
             .groupBy("_sh_cell").agg(F.min("_b_d").alias("_sh_depth"), F.min_by("_b_over", "_b_d").alias("_sh_over")))
    return found.filter(F.col("_sh_depth").isNotNull()), found.filter(F.col("_sh_depth").isNull()).select("_sh_cell")


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text",
          out: tuple[str, str, str] = ("shard", "depth", "n_bytes")) -> DataFrame:
    """``docs`` with its shard (``s`` and the bits of its prefix), the prefix's depth and the text's bytes added.

    Every shard holds at most ``limit_bytes`` of UTF-8 text, except one that
    consists of a single longer document. Null and empty texts have 0 bytes. A
    corpus that fits is one shard ``s``; an empty table gives an empty result.
    Rows that repeat id and text share their hash: if they exceed the limit
    together, they fill overflow shards (``.1``, ``.2``, ... behind the name)
    one after another. Columns of ``docs`` that have the names in ``out`` are
    replaced, all others stay, whatever their names.
    """
    docs, away = set_aside(docs, _HELPERS)
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    rows = docs.withColumns({"_sh_h": doc_hash(id_col, text_col),
                             "_sh_n": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})
    total = rows.agg(F.sum("_sh_n")).first()[0] or 0
    high = min(HASH_BITS, CELL_BITS + max(0, math.ceil(math.log2(max(1, total) / limit_bytes))))
    low, todo, done = 0, rows, []
    while True:
        cells = todo.groupBy(_prefix("_sh_h", high).alias("_sh_cell")).agg(
            F.sum("_sh_n").alias("_sh_bytes"), F.min("_sh_h").alias("_sh_min"), F.max("_sh_h").alias("_sh_max"))
        found, large = _directory(frozen(cells), low, high, limit_bytes)
        found, large = frozen(found), frozen(large)
        done.append((todo, high, found))
        if large.isEmpty():
            break
        todo = todo.join(large.withColumnRenamed("_sh_cell", "_sh_large"), _prefix("_sh_h", high) == F.col("_sh_large"), "left_semi")
        low, high = high + 1, min(HASH_BITS, high + CELL_BITS)

    parts = []
    for part, depth, found in done:
        placed = part.withColumn("_sh_at", _prefix("_sh_h", depth)).join(found, F.col("_sh_at") == F.col("_sh_cell"))
        parts.append(placed.drop("_sh_at", "_sh_cell"))
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    bits = F.when(F.col("_sh_depth") > 0, F.expr(f"lpad(bin(shiftright(_sh_h, {HASH_BITS} - _sh_depth)), _sh_depth, '0')")).otherwise(F.lit(""))
    name, deep, size = (away.get(c, c) for c in out)
    if all(found.filter("_sh_over").isEmpty() for _, _, found in done):
        placed = placed.withColumn("_sh_page", F.lit(0))
    else:
        over = row_number_within(placed.filter("_sh_over"), ["_sh_h"], [F.col(id_col), F.col("_sh_n")], out="_sh_i")
        page = F.expr(f"(_sh_i - 1) div greatest(1, {limit_bytes} div greatest(1, _sh_n))").cast("int")
        placed = (placed.filter("NOT _sh_over").withColumn("_sh_page", F.lit(0))
                  .unionByName(over.withColumn("_sh_page", page).drop("_sh_i")))
    res = placed.withColumns({
        name: F.concat(F.lit("s"), bits, F.when(F.col("_sh_page") > 0, F.concat(F.lit("."), F.col("_sh_page").cast("string"))).otherwise(F.lit(""))),
        deep: F.col("_sh_depth").cast("int"), size: F.col("_sh_n")})
    return put_back(res.drop(*[c for c in res.columns if c.startswith(_HELPERS)]), away)
