"""Texts are moved no more often than needed, and no task gets more of them than it can hold."""

import datetime as dt
import os
import re
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from feedlens import schema as S
from feedlens.operators import changes, enrich
from feedlens.plans import catalog
from feedlens.sources import feedback as src
from feedlens.sources import sinks
from feedlens.streaming import jobs


def same_rows(got, exp):
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


def test_a_replay_reads_as_many_files_as_its_log_has_tasks(spark, monkeypatch):
    log, seen = src.change_log_from_tables(spark, SF_SMALL).repartition(12), []
    monkeypatch.setattr(src, "change_log_from_tables", lambda s, d: log)
    monkeypatch.setattr(catalog, "_files_a_batch", lambda s, path, fmt: seen.append(len(s.read.parquet(path).inputFiles())) or -(-seen[0] // 4))
    same_rows(jobs.read_snapshot(spark, catalog._replayed_log(spark, SF_SMALL)), changes.snapshot(log))
    assert seen[0] >= 12


def test_the_stored_table_is_packed_well(spark, seed):
    out = os.path.join(tempfile.mkdtemp(prefix="feedlens-test-"), "feedback")
    sinks.append_feedback(seed, out)
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    same_rows(src.read_feedback(spark, out).select(*seed.columns), seed)


def test_the_join_with_texts_has_a_task_for_each_share_of_them(spark, monkeypatch):
    few = src.feedback_from_tables(spark, SF_SMALL)
    monkeypatch.setattr(src, "TASK_TEXT_BYTES", 100_000)
    many = src.feedback_from_tables(spark, SF_SMALL)
    assert "REPARTITION_BY_NUM" not in str(few._jdf.queryExecution().executedPlan().toString())
    assert "REPARTITION_BY_NUM" in str(many._jdf.queryExecution().executedPlan().toString())
    same_rows(many, few)


def test_lines_get_their_texts_last(spark):
    whole = src.feedback_from_tables(spark, SF_SMALL)
    late = enrich.digest_lines(whole, rows_of=lambda numbers: src.feedback_from_tables(spark, SF_SMALL, joined=numbers))
    same_rows(late, enrich.digest_lines(whole))
    days = ["2024-01-03", "2024-01-04"]
    same_rows(enrich.digest_lines(whole, days, lambda numbers: src.feedback_from_tables(spark, SF_SMALL, joined=numbers)), enrich.digest_lines(whole, days))


def test_digests_of_late_texts_are_the_same_and_store_no_chunks(spark, monkeypatch):
    whole = src.feedback_from_tables(spark, SF_SMALL)
    want = enrich.daily_digest(whole, enrich.LineCounter(), max_chars=20_000)
    want = spark.createDataFrame(want.collect(), want.schema)
    monkeypatch.setattr(enrich, "DigestChunks", None)
    for size in (1, 20_000, 400_000):
        same_rows(enrich.daily_digest(whole, enrich.LineCounter(), max_chars=size,
                                      rows_of=lambda numbers: src.feedback_from_tables(spark, SF_SMALL, joined=numbers)), want)
    assert catalog.QUERIES["digest_refresh"](spark, SF_SMALL).count() == want.count() + 1


def test_digests_of_late_texts_count_rows_of_one_id_once_each(spark, tmp_path):
    for name in ("events", "documents"):
        rows = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        rows.unionByName(rows.limit(100)).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = src.feedback_from_tables(spark, str(tmp_path))
    want = enrich.daily_digest(whole, enrich.LineCounter(), max_chars=20_000)
    same_rows(enrich.daily_digest(whole, enrich.LineCounter(), max_chars=20_000,
                                  rows_of=lambda numbers: src.feedback_from_tables(spark, str(tmp_path), joined=numbers)), want)
    assert whole.count() > whole.select("id").distinct().count()


def log_of(spark, *events):
    at = dt.datetime(2026, 1, 1)
    rows = [tuple({"seq": seq, "event_ts": at, "op": op, "id": ident, **values}.get(f.name) for f in S.EVENTS.fields) for seq, op, ident, values in events]
    return spark.createDataFrame(rows, S.EVENTS).coalesce(1)


def test_a_hook_gets_the_texts_that_its_delta_needs(spark, tmp_path):
    """Rows whose fingerprint stays get no text, which is so moved for the others alone; a hook that says nothing gets all."""
    seen = {"some": [], "all": []}

    def some(old, new, run, batch_id):
        seen["some"].append([{r["id"]: r["text"] for r in side.collect()} for side in (old, new)])

    def everything(old, new, run, batch_id):
        seen["all"].append([{r["id"]: r["text"] for r in side.collect()} for side in (old, new)])

    some.needs, some.text_with = ["text", "tag", "created_at"], ["tag", "created_at"]
    inserts = [(i, "insert", i, {"text": f"t{i}", "status": "To Do"}) for i in range(1, 6)]
    log_of(spark, *inserts).write.parquet(f"{tmp_path}/in/part=0")
    later = [(11, "patch", 1, {"status": "done"}), (12, "patch", 2, {"tag": "Praise"}), (13, "patch", 3, {"text": "new"}), (14, "delete", 4, {}),
             (16, "insert", 6, {"text": "t6"}), (17, "patch", 7, {"text": "never inserted"}), (18, "patch", 6, {"tag": "Praise"})]
    log_of(spark, *later).write.parquet(f"{tmp_path}/in/part=1")
    stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    jobs.stream_snapshot(stream, f"{tmp_path}/log", f"{tmp_path}/snap", f"{tmp_path}/ck", range_ids=4, on_change=[some, everything]).awaitTermination()
    first = {i: f"t{i}" for i in range(1, 6)}
    touched = {i: f"t{i}" for i in range(1, 5)}
    assert seen["some"][0] == seen["all"][0] == [{}, first]
    assert seen["some"][1] == [touched | {1: None}, {1: None, 2: "t2", 3: "new", 6: "t6"}]
    assert seen["all"][1] == [touched, {1: "t1", 2: "t2", 3: "new", 6: "t6"}]


def test_the_filter_of_places_loses_none_and_keeps_few_others(spark):
    states = spark.range(4000).select(F.col("id") * 1_000_003 - 2_000_000_000, F.lit("r.0-0").alias("part"), F.lit("x").alias("text")).toDF("id", "part", "text")
    places = states.where(F.col("id") % 40 == 0).select("id", "part")
    kept = changes.texts_at(states.unionByName(states.withColumn("part", F.lit("r.1-1"))), places)
    wanted = places.select(F.col("id").alias("_t_id"), F.col("part").alias("_t_part"), F.lit("x").alias("text"))
    assert wanted.exceptAll(kept).count() == 0 and places.count() > 50
    assert kept.count() < places.count() + 2000
    assert changes.texts_at(states, places.where("false")).count() == 0


def test_a_replay_holds_one_batch_of_its_log(spark, monkeypatch):
    held, scratch = [], {}
    real = catalog._scratch
    monkeypatch.setattr(catalog, "_scratch", lambda s, name: scratch.setdefault(name, real(s, name)))

    def look(old, new, run, batch_id):
        folders = [path.removeprefix("file:") for path in (scratch["log"], f"{scratch['stream']}/log/run={run}")]
        held.append(tuple(len([n for n in os.listdir(folder) if "=" in n and n[0] != "."]) for folder in folders))

    look.needs = ["status"]
    snap = catalog._replayed_log(spark, SF_SMALL, [look])
    assert held == [(1, 1)] * catalog.REPLAY_BATCHES
    same_rows(jobs.read_snapshot(spark, snap), changes.snapshot(src.change_log_from_tables(spark, SF_SMALL)))


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    def shuffles():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(f.startswith("shuffle_") for d in folders for _, _, fs in os.walk(d.getPath()) for f in fs)

    before = shuffles()
    jobs.state_parts(spark, f"{tmp_path}/snap").write(changes.fold_state(src.change_log_from_tables(spark, SF_SMALL)), "run", 0, 0)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_winning_texts_come_last_and_no_exchange_carries_them(spark):
    found = catalog.QUERIES["snapshot_fold"](spark, SF_SMALL)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastExchange" in plan or " Exchange" in plan
    assert not [node for node in plan.split("\n\n") if " Exchange" in node.split("\n")[0] and re.search(r"\btext#", node)]
    same_rows(found, changes.snapshot(src.change_log_from_tables(spark, SF_SMALL)))


def test_late_texts_of_a_fold_are_those_of_the_log(spark):
    """Texts that several rows hold, that a later write replaces, that no row holds, and a log without ids."""
    log = log_of(spark, (1, "insert", 1, {"text": "a", "status": "To Do"}), (2, "patch", 1, {"text": "b"}), (2, "patch", 1, {"text": "b"}), (3, "insert", 2, {"text": "c"}),
                 (4, "insert", 3, {"status": "done"}), (5, "delete", 4, {}), (6, "insert", 5, {"text": "d"}), (7, "delete", 5, {"text": "e"}), (8, "analysis", 2, {"tag": "Praise"}))
    nameless = log.unionByName(log.where("seq = 3").withColumn("id", F.lit(None).cast("long")).withColumn("seq", F.lit(9).cast("long")))
    for events in (log, nameless):
        def rows_of(states, events=events):
            assert "text" not in states.columns
            return events.where("text IS NOT NULL").join(states, ["id", "seq"])

        want = changes.fold_state(events)
        same_rows(changes.fold_state(events, rows_of=rows_of), want)
        assert changes.fold_state(events, rows_of=rows_of).count() == want.count() == (5 if events is log else 6)
        same_rows(changes.snapshot(events, True, rows_of), changes.snapshot(events, True))


def test_lines_go_to_their_prompts_in_passes(spark, monkeypatch):
    """Many lines go a share at a time, and a pass leaves no exchange; digests are those of one pass."""
    whole, passes = src.feedback_from_tables(spark, SF_SMALL), []

    def rows_of(numbers):
        passes.append(numbers.count())
        return src.feedback_from_tables(spark, SF_SMALL, joined=numbers)

    want = enrich.daily_digest(whole, enrich.LineCounter(), max_chars=20_000, rows_of=rows_of).collect()
    monkeypatch.setattr(enrich, "SLICE_CHARS", 500_000)
    got = enrich.daily_digest(whole, enrich.LineCounter(), max_chars=20_000, rows_of=rows_of).collect()
    assert sorted(got) == sorted(want) and len(passes) > 3
    assert sum(passes[1:]) == passes[0] == whole.count() and max(passes[1:]) < whole.count() / 2
