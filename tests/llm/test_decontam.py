import random

import numpy as np

from feedlens.llm import decontam


def words(text):
    return [w for w in (x.strip(decontam._SIGNS) for x in (text or "").lower().split()) if w]


def brute(docs, items, k=4, threshold=0.5):
    """Contaminated (document, item) pairs by the definition: items and documents as lists of words."""
    out = []
    for d, text in docs:
        doc = words(text)
        for i, t in items:
            item = words(t)
            n = min(k, len(item))
            need = len(item) if len(item) <= 2 * k else threshold * len(item)
            grams = {tuple(doc[j:j + n]) for j in range(len(doc) - n + 1)}
            if item and sum(tuple(item[j:j + n]) in grams for j in range(len(item) - n + 1)) * n >= need and slow_tiles(item, doc, n) >= need:
                out.append((d, i))
    return sorted(out, key=str)


def slow_tiles(a, b, k):
    """Greedy string tiling by its definition."""
    ma, mb, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                    n += 1
                if (n, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sum(t for t in found)
        found.append(n)
        ma.update(range(i, i + n))
        mb.update(range(j, j + n))


def test_tiling_against_its_definition():
    rng = random.Random(3)
    for trial in range(60):
        vocab = [f"w{i}" for i in range(rng.choice([3, 8, 40]))]
        item = [rng.choice(vocab) for _ in range(rng.randint(4, 30))]
        parts = [item[i: i + 7] for i in range(0, len(item), 7)]
        rng.shuffle(parts)
        doc = [rng.choice(vocab) for _ in range(10)] + [w for p in parts for w in p] + [rng.choice(vocab) for _ in range(10)]
        pairs = sorted((j - i, i, j) for i in range(len(item) - 3) for j in range(len(doc) - 3) if item[i:i + 4] == doc[j:j + 4])
        i, j = (np.array([p[x] for p in pairs], dtype=np.int64) for x in (1, 2))
        got = decontam.cover(i, j, 4, len(item), 1) if pairs else None
        assert (got[0] if got else 0) == slow_tiles(item, doc, 4), trial


def sentences(seed, n):
    rng = random.Random(seed)
    return [" ".join(f"s{seed}x{rng.randrange(999)}" for _ in range(9)) + "." for _ in range(n)]


def test_finds_moved_and_altered_passages(spark):
    item = sentences(1, 5)
    other = sentences(2, 5)
    docs = [(1, " ".join(sentences(9, 3) + item + sentences(8, 2))),
            (2, " ".join([item[3], *sentences(7, 1), item[0], item[4], item[1], item[2]]).upper().replace(".", " ,")),
            (3, " ".join(other[:2] + sentences(6, 4))),            # two of five sentences
            (4, " ".join(other[:3] + sentences(6, 4))),            # three of five
            (5, " ".join(sentences(5, 30))), (6, None), (7, ""), (None, " ".join(item)), (1, " ".join(item)), (8, " ".join(item) * 400)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, tiles string")
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, " ".join(other), 1), (12, None, 1), (13, "the of", 1), (None, " ".join(sentences(4, 3)), 1)],
                                  "item_id long, text string, doc_id int")
    got = sorted([(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()], key=str)
    assert got == sorted([(1, 10), (2, 10), (4, 11), (None, 10), (1, 10), (8, 10)], key=str)
    left = decontam.clean(df, bench)
    assert left.columns == df.columns
    assert sorted([r["doc_id"] for r in left.collect()]) == [3, 5, 6, 7]


def test_against_brute_force(spark, monkeypatch):
    """Few words, so that chance matches, repeats and overlaps abound; items of all lengths, batches that cut pairs."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 8, 9, 14, 30]))) for i in range(25)] + [(None, text(12)), (3, text(10)), (4, ""), (5, None), (6, "!!! ...")]
    docs = [(d, text(rng.choice([0, 3, 10, 60]))) for d in range(60)]
    for d in range(60, 120):
        parts = words(rng.choice(items[:25])[1])
        cut = rng.randrange(len(parts) + 1)
        docs.append((d, " ".join([text(5), *parts[cut:], text(3), *parts[:cut], text(4)]).upper()))
    docs += [docs[70], docs[70], (None, docs[80][1]), (500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    monkeypatch.setattr(decontam, "_FILTER_BITS", 6)  # a bitmap that lets much through: the join decides
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()), key=str)
        left = sorted(((r["doc_id"], r["text"]) for r in decontam.clean(df, bench).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) > 40
    assert left == sorted(((d, t) for d, t in docs if not brute([(d, t)], items)), key=str) and len(left) > 20
    monkeypatch.setattr(decontam, "BROADCAST_TEXTS", 0)
    assert sorted(((r["doc_id"], r["text"]) for r in decontam.clean(df, bench).collect()), key=str) == left


def test_seeds_are_joined(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = decontam.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Join [k" in plan and "t_seed" in plan.split("Join [k")[1].split("\n")[0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.clean(docs, bench.limit(0)).count() == 1


def test_short_items_match_as_a_whole(spark):
    bench = spark.createDataFrame([(1, "what is two"), (2, "the capital of france is paris"), (3, "Yes!"), (4, "..."), (5, "a b c d e f g h"), (6, "to be")], "item_id long, text string")
    docs = [(1, "What is two?"), (2, "I think that the capital of France has been rebuilt"), (3, "so: The capital of France is Paris."), (4, "no"), (5, "oh yes, it is"),
            (6, "e f g h and a b c d"), (7, "a b c d e f g"), (8, "what is it"), (9, "be to"), (10, "what is two and the capital of France is Paris"), (11, None), (12, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in decontam.contaminated(df, bench).collect())
    assert got == [(1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0), (6, 5, 1.0), (10, 1, 1.0), (10, 2, 1.0)]
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench).collect()) == [2, 4, 7, 8, 9, 11, 12]


def test_one_seed_in_every_document(spark):
    """A run of words that all documents share contaminates none of them by itself."""
    common = "all rights are reserved by"
    bench = spark.createDataFrame([(1, common + " " + sentences(1, 2)[0] + " " + sentences(1, 2)[1])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{common} {sentences(50 + k, 2)[0]} {common}") for k in range(200)] + [(900, common + " " + " ".join(sentences(1, 2)))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()] == [(900, 1)]
