"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each runs a feedlens operator over the feedback view derived from the
driver's tables (``sources.feedback.feedback_from_tables``) or over request
/ event streams derived from them. Parameters are the operator's own
(a date, a search string, a page); nothing subsets the tables.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.analysis import keyword_scores, normalize_analysis
from feedlens.operators import changes, digests, distribution, enrich, library, rollups, timeline
from feedlens.session import checkpoint_dir, frozen, remove, short_shuffles
from feedlens.streaming import jobs
from feedlens.sources import feedback as src
from feedlens.sources import ingest as ing
from feedlens.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

# Operator parameters used by the registered queries.
BY_DATE = "2024-01-15"
SEARCH_Q = "c:\\temp"
SEARCH_WILDCARD_Q = "50%"
PAGE = dict(status="done", sort_key="positive_desc", size=10, page_no=3)
PAGE_PAST_END = 1_000_000
DEEP_PAGE = 7
SINGLE_ID = 42
INGEST_START = "2024-03-01 00:00:00"
KEYSET_AFTER = ("2024-01-15 12:00:00", 0)
SUMMARY_NOW = datetime.datetime(2024, 2, 1, 0, 0, 0)


def _fb(spark, d, text=False, raw=False, spread=None):
    return src.feedback_from_tables(spark, d, with_text=text, with_raw_response=raw, spread_out=spread)


def _library_page(spark, d, page_no, sort_key=PAGE["sort_key"], pager=library.page, **filters):
    """Ids of the page from narrow columns; then the rows, and so the texts, of those ids only."""
    ids = pager(library.filter_feedback(_fb(spark, d), **(filters or {"status": PAGE["status"]})), sort_key, PAGE["size"], page_no)
    rows = src.feedback_from_tables(spark, d, only=ids).select(*library.LIBRARY_COLUMNS)
    return library.sort_feedback(rows, sort_key)


def _late_text(spark, d, top):
    """The rows of the ids that ``top`` picks from narrow columns, with their texts."""
    return src.feedback_from_tables(spark, d, only=top(_fb(spark, d)).select("id"))


def _stored_table(spark, d):
    """The feedback view written as the stored table and scanned back."""
    path = f"{checkpoint_dir(spark)}/feedback-{uuid.uuid4().hex}"
    sinks.append_feedback(_fb(spark, d, text=True), path)
    return src.read_feedback(spark, path).select(*S.FEEDBACK_COLUMNS)


def _keyword_classify(spark, d):
    fb = _fb(spark, d, text=True)
    return fb.select("id", keyword_scores("text")["tag"].alias("tag"))


def _classify_pending(spark, d):
    return enrich.analyze(_fb(spark, d, text=True), enrich.keyword_response_scorer)


def _ingest(spark, d):
    out = ing.ingest(src.ingest_requests_from_tables(spark, d))
    return out.select("conv_id", "turn", "text", "source", "channel", "severity_hint", "user_tier", "reject_reason")


def _changes(spark, d):
    return ing.parse_changes(src.change_requests_from_tables(spark, d), keep=("request_id",))


def _ingest_to_snapshot(spark, d):
    """Requests to current rows: validate, number, classify, log, change, fold."""
    rows = sinks.assign_ids(ing.accepted(ing.ingest(src.ingest_requests_from_tables(spark, d))), 1, ["conv_id", "turn"])
    start = F.lit(INGEST_START).cast("timestamp_ntz")
    created = F.timestamp_add("MINUTE", F.col("id"), start)
    log = changes.ingest_log(rows, enrich.analyze(rows, enrich.keyword_response_scorer), created,
                             F.timestamp_add("SECOND", F.lit(30), created))
    asked = ing.parse_changes(src.conversation_changes_from_tables(spark, d), keep=("request_id",))
    later = changes.change_events(asked, F.lit(1 << 40) + F.col("request_id"),
                                  F.timestamp_add("DAY", F.lit(30), F.timestamp_add("SECOND", F.col("request_id"), start)))
    return changes.snapshot(log.unionByName(later))


#: Micro-batches of a replay; parts of a level, so that the replay merges some.
REPLAY_BATCHES, REPLAY_FANOUT = 4, 2


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files_a_batch(spark, path, fmt):
    return max(1, -(-len(spark.read.format(fmt).load(path).inputFiles()) // REPLAY_BATCHES))


def _replayed_log(spark, d, hooks=()):
    """The derived log replayed as a stream; the folder of the snapshot it leaves.

    Each batch's share of the log is written when it is due, and gone once the batch is committed: the stream
    is started again from its checkpoint. So what lies here besides the state is the texts of a batch, not of the log."""
    inp, out = _scratch(spark, "log"), _scratch(spark, "stream")
    log = src.change_log_from_tables(spark, d)
    for part in range(REPLAY_BATCHES):
        # every task writes its own rows: no exchange, and files of a task's size
        with short_shuffles(spark):
            log.where(F.pmod(F.xxhash64("seq"), F.lit(REPLAY_BATCHES)) == part).write.option("compression", "zstd").parquet(f"{inp}/part={part}")
        files = _files_a_batch(spark, inp, "parquet") * REPLAY_BATCHES  # all that are here
        stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", files).parquet(f"{inp}/part=*")
        jobs.stream_snapshot(stream, f"{out}/log", f"{out}/snapshot", f"{out}/checkpoint", fanout=REPLAY_FANOUT, on_change=hooks).awaitTermination()
        remove(spark, f"{inp}/part={part}")
        remove(spark, f"{out}/log")
    remove(spark, inp)
    return f"{out}/snapshot"


def _stream_snapshot(spark, d):
    return jobs.read_snapshot(spark, _replayed_log(spark, d))


def _stream_rollups(spark, d):
    cells = _scratch(spark, "rollups")
    _replayed_log(spark, d, [jobs.publish_rollups(cells, REPLAY_FANOUT)])
    return jobs.read_rollups(spark, cells)


def _stream_digest_state(spark, d):
    days = _scratch(spark, "days")
    _replayed_log(spark, d, [jobs.publish_digest_state(days, REPLAY_FANOUT)])
    return jobs.read_digest_state(spark, days).select("date", "count", "row_fingerprint")


def _stream_ingest(spark, d):
    """Request bodies replayed as a stream of text files: validated, numbered, classified, logged, folded."""
    inp, out = _scratch(spark, "requests"), _scratch(spark, "ingest")
    src.ingest_requests_from_tables(spark, d).select("value").repartition(REPLAY_BATCHES).write.text(inp)
    jobs.stream_ingest(spark, inp, out, f"{out}/checkpoint", max_files_per_trigger=_files_a_batch(spark, inp, "text")).awaitTermination()
    remove(spark, inp)
    rows = changes.snapshot(spark.read.parquet(f"{out}/events").select(*S.EVENTS.fieldNames()))
    dense = rows.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"))
    return rows.select("text", "source", "channel", "severity_hint", "user_tier", "tag", "sentiment", "urgency_score", "summary", "status",
                       dense.select("first_id").scalar().alias("first_id"), dense.select("last_id").scalar().alias("last_id"),
                       dense.select("ids").scalar().alias("ids"))


DIGEST_NOW = datetime.datetime(2024, 3, 1, 12, 0, 0)


def _digest_refresh(spark, d):
    """Stored digests brought up to date from the days' kept state.

    By day number modulo 5: 0 nothing has happened; 1 error rows have been
    deleted; 2 click rows have been re-tagged; 3 the digest has expired; 4 there
    is none. The day after the last is asked for, too, and has no rows.
    """
    gen = enrich.LineCounter()
    number = F.date_diff("date", F.lit("1970-01-01").cast("date")) % 5

    def view(numbers=None):
        return src.feedback_from_tables(spark, d, keep=("event_type",), joined=numbers).withColumn("date", F.to_date("created_at"))

    rows = view()
    gone = (number == 1) & (F.col("ev_event_type") == "error")
    tagged = (number == 2) & (F.col("ev_event_type") == "click")

    def tag_again(df):
        return df.withColumn("tag", F.when(tagged, F.lit("Praise")).otherwise(F.col("tag")))

    retag = tag_again(rows)
    now_rows = retag.where(~gone)
    before = frozen(digests.digest_state(rows))  # a row for each date
    state = frozen(digests.add_day_states(before.unionByName(digests.day_state_delta(rows.where(gone | tagged), retag.where(tagged)))))
    first = digests.refresh_digests(rows, None, gen, DIGEST_NOW, state=before, rows_of=view).where(number != 4)
    age = F.when(number == 3, F.lit(30)).otherwise(F.lit(1))
    path = _scratch(spark, "digests")
    digests.write_digests(first.withColumn("generated_at", F.timestamp_add("HOUR", -age, F.col("generated_at"))), path)
    prior = spark.read.parquet(path)
    days = before.select("date")
    asked = days.unionByName(days.agg(F.date_add(F.max("date"), 1).alias("date")))
    digests.write_digests(digests.refresh_digests(now_rows, prior, gen, DIGEST_NOW, dates=asked, state=digests.days_with_rows(state),
                                                  rows_of=lambda numbers: tag_again(view(numbers)).where(~gone)), path)
    spark.catalog.refreshByPath(path)
    res = spark.read.parquet(path)
    return res.select("date", "summary", "count", F.col("row_fingerprint").cast("string").alias("row_fingerprint"), F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"))


def _result_output(spark, d):
    """The summary counts written as JSON lines and read back."""
    path = _scratch(spark, "result")
    sinks.write_result(rollups.summary_counts(_fb(spark, d)), path, "json")
    return spark.read.schema("section string, key string, count long").json(path)


def _similar_items(spark, d):
    fb = _fb(spark, d)
    return library.similar_items(fb, library.urgency_impact(fb))


def _similar_classes(spark, d):
    """All rows as points: how many rows each is similar to."""
    fb = _fb(spark, d)
    return library.SimilarItems(fb, fb).points


def _search_lookup(spark, d):
    fb = _fb(spark, d, text=True)
    return library.lookup(fb, library.search_text(fb, SEARCH_Q), ["id", "status", "user_tier", "updated_at"])


def _summary_payload(spark, d):
    """The /summary payload as JSON text, generated at a fixed instant."""
    out = digests.summary_payload(_fb(spark, d, text=True), SUMMARY_NOW)
    return out.select(F.to_json("tags").alias("tags"), F.to_json("sentiment").alias("sentiment"),
                      "narrative_input", "generated_at")


def _similar_texts(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    res = enrich.similar_texts(emb, enrich.label_centroids(emb), k=10)
    return res.select(F.col("query_id").alias("label"), "rank", F.col("id").alias("vec_id"),
                      F.round("score", 4).alias("score"))


_QUERIES: dict[str, Query] = {
    "tag_counts": lambda s, d: rollups.tag_counts(_fb(s, d)),
    "sentiment_counts": lambda s, d: rollups.sentiment_counts(_fb(s, d)),
    "status_timeline": lambda s, d: rollups.status_timeline(_fb(s, d)),
    "status_timeline_dense": lambda s, d: rollups.status_timeline_dense(_fb(s, d)),
    "sentiment_by_tier": lambda s, d: rollups.sentiment_by_tier(_fb(s, d)),
    "sentiment_by_dimension_status": lambda s, d: rollups.sentiment_by_dimension(_fb(s, d), "status"),
    "sentiment_by_dimension_tag": lambda s, d: rollups.sentiment_by_dimension(_fb(s, d), "tag"),
    "sentiment_by_dimension_channel": lambda s, d: rollups.sentiment_by_dimension(_fb(s, d), "channel"),
    "sentiment_boxplot_tier": lambda s, d: distribution.sentiment_boxplot(_fb(s, d), "tier"),
    "sentiment_boxplot_status": lambda s, d: distribution.sentiment_boxplot(_fb(s, d), "status"),
    "sentiment_boxplot_tag": lambda s, d: distribution.sentiment_boxplot(_fb(s, d), "tag"),
    "sentiment_boxplot_channel": lambda s, d: distribution.sentiment_boxplot(_fb(s, d), "channel"),
    "resolution_time": lambda s, d: rollups.resolution_time(_fb(s, d)),
    "resolution_time_actionable": lambda s, d: rollups.resolution_time(_fb(s, d), actionable_only=True),
    "feedback_dates": lambda s, d: rollups.feedback_dates(_fb(s, d)),
    "feedback_by_date": lambda s, d: library.feedback_by_date(_fb(s, d, text=True), BY_DATE),
    "date_span": lambda s, d: rollups.date_span(_fb(s, d)),
    "latest_feedback": lambda s, d: library.latest_feedback(_late_text(
        s, d, lambda fb: fb.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(S.LIBRARY_LIMIT))),
    "latest_analyzed": lambda s, d: library.latest_analyzed(_late_text(
        s, d, lambda fb: fb.where("analyzed_at IS NOT NULL").orderBy(F.col("analyzed_at").desc(), F.col("id").desc()).limit(
            S.LATEST_ANALYZED_LIMIT))),
    "search_text": lambda s, d: library.search_text(_fb(s, d, text=True), SEARCH_Q),
    "search_text_wildcard": lambda s, d: library.search_text(_fb(s, d, text=True), SEARCH_WILDCARD_Q),
    "search_lookup": _search_lookup,
    "urgency_impact": lambda s, d: library.urgency_impact(_fb(s, d)),
    "filter_sort_page": lambda s, d: _library_page(s, d, PAGE["page_no"]),
    "filter_sort_page_past_end": lambda s, d: _library_page(s, d, PAGE_PAST_END),
    "filter_sort_page_deep": lambda s, d: _library_page(s, d, DEEP_PAGE, "created_asc", library.deep_page, tier="pro"),
    **{f"sort_{k}": (lambda s, d, k=k: _library_page(s, d, 2, k, channel="github"))
       for k in ("updated_desc", "updated_asc", "created_desc", "created_asc", "negative_desc")},
    "filter_tier_channel_tag": lambda s, d: library.filter_feedback(_fb(s, d), tier="free", channel="web", tag="Bug Report").select("id"),
    "filter_sentiment_class": lambda s, d: library.filter_feedback(_fb(s, d), sentiment_class_="negative").select("id", "sentiment"),
    "filter_id": lambda s, d: library.filter_feedback(_fb(s, d), id=SINGLE_ID).select("id", "status", "tag"),
    "drill_down": lambda s, d: library.drill_down(_fb(s, d), SINGLE_ID),
    "stored_table": _stored_table,
    "stale_digest_state": lambda s, d: digests.digest_state(_fb(s, d, text=True)).select("date", "count", "max_updated_at"),
    "page_count": lambda s, d: library.page_count(library.filter_feedback(_fb(s, d), status=PAGE["status"]), PAGE["size"]),
    "visible_columns": lambda s, d: library.project_columns(
        _fb(s, d, spread=True), ["when", "id", "tier", "channel", "status", "sentiment", "tag"],
        {"when": True, "id": True, "tier": True, "channel": True, "status": True, "sentiment": True, "tag": False}, "created_asc"),
    "timeline_intervals": lambda s, d: timeline.timeline_intervals(_fb(s, d), "status"),
    "peak_concurrency": lambda s, d: timeline.peak_concurrency(_fb(s, d), "status"),
    "peak_concurrency_tier": lambda s, d: timeline.peak_concurrency(_fb(s, d), "tier"),
    "peak_concurrency_tag": lambda s, d: timeline.peak_concurrency(_fb(s, d), "tag"),
    "timeline_lanes": lambda s, d: timeline.timeline_lanes(_fb(s, d), "status"),
    "date_spine": lambda s, d: timeline.date_spine(_fb(s, d)),
    "keyword_classify": _keyword_classify,
    "classify_pending": _classify_pending,
    "normalize_analysis": lambda s, d: normalize_analysis(_fb(s, d, raw=True).select("id", "raw_response")).drop("raw_response"),
    "snapshot_fold": lambda s, d: changes.snapshot(
        src.change_log_from_tables(s, d), rows_of=lambda states: src.change_log_from_tables(s, d, joined=states)),
    "stream_snapshot": _stream_snapshot,
    "stream_rollups": _stream_rollups,
    "stream_digest_state": _stream_digest_state,
    "stream_ingest": _stream_ingest,
    "digest_refresh": _digest_refresh,
    "result_output": _result_output,
    "ingest_feedback": _ingest,
    "parse_changes": _changes,
    "ingest_to_snapshot": _ingest_to_snapshot,
    "similar_items": _similar_items,
    "similar_classes": _similar_classes,
    "stakeholder_rollup": lambda s, d: rollups.stakeholder_rollup(_fb(s, d)),
    "mood_bands": lambda s, d: rollups.mood_bands(_fb(s, d)),
    "daily_digest_prompt": lambda s, d: enrich.digest_lines(
        _fb(s, d, text=True), rows_of=lambda numbers: src.feedback_from_tables(s, d, joined=numbers)),
    "summary_bundle": lambda s, d: rollups.summary_counts(_fb(s, d)),
    "narrative_input": lambda s, d: enrich.narrative_input(_fb(s, d, text=True)),
    "similar_texts": _similar_texts,
    "daily_digest": lambda s, d: enrich.daily_digest(
        _fb(s, d, text=True), enrich.LineCounter(), rows_of=lambda numbers: src.feedback_from_tables(s, d, joined=numbers)),
    "status_timeline_wide": lambda s, d: rollups.status_timeline_wide(_fb(s, d)),
    "sentiment_histogram_tier": lambda s, d: rollups.sentiment_values_compact(_fb(s, d), "tier"),
    "keyset_page": lambda s, d: library.keyset_page(_fb(s, d, text=True).select(*library.LIBRARY_COLUMNS), 20,
                                                    KEYSET_AFTER[0], KEYSET_AFTER[1]),
    "event_day_counts": lambda s, d: jobs.event_day_counts(src.change_log_from_tables(s, d, with_text=False), "1 day"),
    "summary_payload": _summary_payload,
    "urgency_bubbles": lambda s, d: library.urgency_bubbles(_fb(s, d)),
    "sentiment_slider": lambda s, d: library.sentiment_slider(_fb(s, d, spread=True)),
    "timeline_bar_labels": lambda s, d: timeline.bar_labels(_fb(s, d, text=True), "status"),
    "sentiment_chart": lambda s, d: rollups.sentiment_chart(_fb(s, d)),
    "assign_ids_dense": lambda s, d: sinks.assign_ids(
        ing.accepted(ing.ingest(src.ingest_requests_from_tables(s, d))).select("conv_id", "turn", "text"),
        1, ["conv_id", "turn"]),
}


def _dates_as_text(q: Query) -> Query:
    """Registered results carry DATE columns as ISO ``yyyy-MM-dd`` text so the
    Spark result and the SQL oracle hash the same way in any client."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q(spark, sf_dir)
        dates = [f.name for f in df.schema.fields if f.dataType.typeName() == "date"]
        return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df
    return run


QUERIES: dict[str, Query] = {k: _dates_as_text(v) for k, v in _QUERIES.items()}
