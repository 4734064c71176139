"""Mixing sources to target weights by capped water-filling.

Every source has a weight and can be repeated ``max_epochs`` times at most.
Targets share the corpus size by weight; a source whose share exceeds its
limit is clamped, and the excess goes to the others by weight, again and
again until no share exceeds its limit. Only two numbers per round reach the
driver (the clamped size and the free weight).

A source takes whole repetitions of all its documents, and a last, fractional
repetition in a seeded order of documents up to the word its target asks for.
That order is a hash of the seed and the document's id, cut into
``2 ** BUCKET_BITS`` buckets: sums per (source, bucket) tell which buckets are
taken whole, and only the rows of the one bucket where a source's target ends
are sorted. So the work of a hot source is spread over all tasks. Everything
runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import frozen, null_safe, put_back, set_aside, word_count
from feedlens.plans.ranking import row_number_within

BUCKET_BITS = 12
#: Helper columns begin so.
_HELPERS = ("_mx_", "_e_", "_p_")
#: The plan (a row of numbers per source) is broadcast up to so many sources; beyond, rows are joined by source.
BROADCAST_SOURCES = 10_000


def _per_source(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: its size and weight; sources ranked by code point, null last."""
    sums = sized.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_total"))
    ranked = row_number_within(sums, [], [F.col("_mx_source").asc_nulls_last()], out="_mx_rank")
    w = F.array(*[F.lit(float(x)) for x in weights])
    return ranked.withColumn("_mx_w", w[((F.col("_mx_rank") - 1) % len(weights)).cast("int")]).drop("_mx_rank")


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight at which the clamped targets add up to the corpus size."""
    cap = F.col("_mx_total") * max_epochs
    total, free = sources.agg(F.sum("_mx_total"), F.sum(F.when(F.col("_mx_total") > 0, F.col("_mx_w")))).first()
    if not total:
        return 0.0
    level = total / free
    while True:
        over = cap < F.lit(level) * F.col("_mx_w")
        clamped, free = sources.agg(F.sum(F.when(over, cap).otherwise(0)),
                                    F.sum(F.when(~over, F.col("_mx_w")).otherwise(0.0))).first()
        if not free:  # all clamped: only if max_epochs is 1 and every target is its source's size
            return level
        raised = (total - clamped) / free
        if raised <= level:
            return level
        level = raised


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7,
        out: tuple[str, str, str, str] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """``docs`` with its size, its source's size and target, and the words taken added.

    Size is the number of words of the text (null or empty: 0). Weights go to
    the sources in code-point order, null last, repeating; a null source is a
    source. A source's taken words are its target to the nearest word. A
    document takes whole repetitions, and the last repetition of a source goes
    through its documents in seeded order; the document in which the target
    ends takes only a part. Repeated rows are separate documents; rows that
    also share the id take their places in the order by size. Empty tables
    give an empty result, sources without words a target of 0. Columns of
    ``docs`` that have the names in ``out`` are replaced, all others stay,
    whatever their names. Reruns agree: the order depends on the seed and the ids only.
    """
    docs, away = set_aside(docs, _HELPERS)
    id_col, text_col, source_col = (away.get(c, c) for c in (id_col, text_col, source_col))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumns({"_mx_source": F.col(source_col), "_mx_size": word_count(F.col(text_col)),
                             "_mx_order": order,
                             "_mx_bucket": F.conv(F.substring(order, 1, BUCKET_BITS // 4), 16, 10).cast("int")})
    sums = frozen(rows.groupBy("_mx_source", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_size")))
    sources = frozen(_per_source(sums, weights))
    level = water_level(sources, max_epochs)
    sources = sources.withColumn("_mx_target", F.least(F.col("_mx_total") * float(max_epochs), F.lit(level) * F.col("_mx_w")))
    words = F.floor(F.col("_mx_target") + 0.5).cast("long")
    sources = sources.withColumn("_mx_words", words).withColumns({
        "_mx_whole": F.when(F.col("_mx_total") > 0, F.expr("_mx_words div _mx_total")).otherwise(F.lit(0)).cast("long"),
    }).withColumn("_mx_extra", F.col("_mx_words") - F.col("_mx_whole") * F.col("_mx_total"))

    # the bucket in which each source's last repetition ends, and the words before it
    before = F.coalesce(F.sum("_mx_size").over(Window.partitionBy("_mx_source").orderBy("_mx_bucket")
                                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("_mx_before", before).withColumnsRenamed(
        {"_mx_source": "_e_source", "_mx_bucket": "_e_bucket", "_mx_size": "_e_size"})
    ends = (sources.join(ends, null_safe(sources, ends, {"_mx_source": "_e_source"}))
            .filter((F.col("_mx_before") <= F.col("_mx_extra")) & (F.col("_mx_extra") < F.col("_mx_before") + F.col("_e_size")))
            .select("_e_source", "_e_bucket", "_mx_before"))
    plan = (sources.join(ends, null_safe(sources, ends, {"_mx_source": "_e_source"}), "left")
            .select(F.col("_mx_source").alias("_p_source"), "_mx_total", "_mx_target", "_mx_whole", "_mx_extra",
                    "_e_bucket", "_mx_before"))

    if sources.count() <= BROADCAST_SOURCES:  # else the texts of a hot source would travel by its name
        plan = F.broadcast(plan)
    planned = rows.join(plan, null_safe(rows, plan, {"_mx_source": "_p_source"}))
    at_end = F.coalesce(F.col("_mx_bucket") == F.col("_e_bucket"), F.lit(False))
    outside = planned.filter(~at_end).withColumn(
        "_mx_last", F.when(F.coalesce(F.col("_mx_bucket") < F.col("_e_bucket"), F.lit(False)), F.col("_mx_size")).otherwise(F.lit(0)))
    run = F.coalesce(F.sum("_mx_size").over(Window.partitionBy("_mx_source")
                                            .orderBy("_mx_order", F.col(id_col).asc_nulls_first(), "_mx_size")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ending = planned.filter(at_end).withColumn(
        "_mx_last", F.greatest(F.lit(0), F.least(F.col("_mx_size"), F.col("_mx_extra") - F.col("_mx_before") - run)))
    size, source_size, target, taken = (away.get(c, c) for c in out)
    res = outside.unionByName(ending).withColumns({
        size: F.col("_mx_size"), source_size: F.col("_mx_total"), target: F.col("_mx_target"),
        taken: F.col("_mx_whole") * F.col("_mx_size") + F.col("_mx_last").cast("long")})
    return put_back(res.drop(*[c for c in res.columns if c.startswith(_HELPERS)]), away)


def repeated(docs: DataFrame, size: str = "size", taken: str = "taken") -> DataFrame:
    """Rows of a mixed table as often as the mix takes them: whole repetitions, and
    one more where it takes half or more of the words of the last one. Documents
    without words (null, empty or blank texts) have no words to take and are removed,
    whatever the target of their source."""
    docs, away = set_aside(docs, _HELPERS)
    size, taken = away.get(size, size), away.get(taken, taken)
    n = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size) + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    times = docs.withColumn("_mx_times", n).filter(F.col("_mx_times") > 0)
    return put_back(times.withColumn("_mx_i", F.explode(F.sequence(F.lit(1), F.col("_mx_times")))).drop("_mx_times", "_mx_i"), away)
