"""Each stage of the pipeline against a plain version over its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from feedlens.llm import queries, simhash, toxicity
from test_decontam import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        tables.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    return tables


def key(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["detox", "near_dedup", "decontaminate", "mix", "shard"]


def test_columns(steps):
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == COLUMNS
    assert list(steps[-1][0].asDict()) == [*COLUMNS, "shard", "depth", "n_bytes"]


def test_detox(spark, steps):
    scorer = queries.toxicity_scorer(spark, SF)
    r = scorer.restorer()
    assert key(steps[1]) == key([d for d in steps[0] if scorer.score(d["text"], r) < toxicity.THRESHOLD])


def test_near_dedup(steps):
    rows = steps[1]
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    first = {}
    for r, x in zip(rows, label):
        first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    assert key(steps[2]) == key([r for r in rows if r["doc_id"] in first.values()])


def test_decontaminate(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert key(steps[3]) == key([r for r in steps[2] if not brute([(0, r["text"])], items)])
    assert len(steps[3]) < len(steps[2])


def test_mix(steps):
    docs = [(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest(), r, len(r["text"].split())) for r in steps[3]]
    size = Counter()
    for _, r, n in docs:
        size[r["source"]] += n
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    level = 0.0
    for _ in range(50):
        fixed = {s for s in size if 3 * size[s] < level * weight[s]}
        level = (sum(size.values()) - sum(3 * size[s] for s in fixed)) / sum(weight[s] for s in size if s not in fixed)
    want = Counter()
    for s in size:
        words = int(min(3 * size[s], level * weight[s]) + 0.5)
        whole, left = divmod(words, size[s])
        for _, r, n in sorted([d for d in docs if d[1]["source"] == s], key=lambda d: d[0]):
            part = min(max(left, 0), n)
            left -= n
            times = int((whole * n + part) / n + 0.5)
            if times:
                want[tuple(r[c] for c in COLUMNS)] += times
    assert key(steps[4]) == want


def test_shard(steps):
    assert key(steps[5]) == key(steps[4])
    size = Counter()
    for r in steps[5]:
        size[r["shard"]] += r["n_bytes"]
    assert max(size.values()) <= queries.SHARD_BYTES


def test_run_writes_and_reads(spark, steps):
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(steps[5])


def test_stages_take_odd_rows_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double"
    rows = [(None, None, None, None, None, 1, "s", 0.5), (1, "", "", "", 0, 1, None, None), (1, "", "", "", 0, 1, None, None),
            (2, "a b c d e f", "en", None, 1, None, "x", 1.0), (3, "w " * 50_000, "en", "src", 1, 2, "y", 0.0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
