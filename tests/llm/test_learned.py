import zlib

import pytest

from feedlens.llm import langid, toxicity
from feedlens.llm.common import read_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


def test_language_held_out_accuracy(spark, docs):
    models = langid.fit(docs, per_lang=250)
    assert models.langs == ["de", "en", "es", "fr"] and models.families == ["germanic", "romance"]
    got = langid.identify(docs.select("doc_id", "text", "lang"), models).filter("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert len(got) > 3000
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !? _ 4", "c"), (None, "der die das und nicht", "d"), (5, "x" * 300_000, "e"),
                                 (6, "的", "f")], "doc_id long, text string, score string")
    res = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, models).collect()}
    assert res[1] == res[2] == res[3] == ("und", 0.0)
    assert res[None][0] == "de" and all(res[i][0] in models.langs for i in (5, 6))


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc def", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(df, langid.fit(df)).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).collect() == []


def test_one_language_only(spark):
    ids = [i for i in range(20) if not is_held_out(i)]
    df = spark.createDataFrame([(i, "hello there", "en") for i in ids], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df)).collect()} == {"en"}


@pytest.fixture(scope="module")
def scorer(spark, docs):
    return toxicity.fit(docs, read_table(spark, SF, "labels"))


def test_toxicity_held_out(spark, docs, scorer):
    labels = read_table(spark, SF, "labels").select("doc_id", "toxic")
    got = toxicity.score(docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1"), scorer).select("toxic", "score").collect()
    said = [r for r in got if r["score"] >= toxicity.THRESHOLD]
    assert sum(r["toxic"] for r in said) / len(said) > 0.95
    assert sum(r["toxic"] for r in said) / sum(r["toxic"] for r in got) > 0.7
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("st*pid", "stupid"), ("w0rthl3ss", "worthless"), ("p@thet1c", "pathetic"),
    ("l0$er", "loser"), ("i d i o t", "idiot"), ("tr4sh", "trash"), ("m-o-r-o-n", "moron"), ("stttuuupid", "stupid")])
def test_restores_disguised_words(scorer, written, meant):
    assert toxicity.restore(written, scorer.model) == meant


def test_disguise_does_not_lower_the_score(scorer):
    plain = scorer.score("you are a worthless idiot and a pathetic loser", scorer.restorer())
    hidden = scorer.score("you are a w0rthl3ss 1d1ot and a p@thetic l o s e r", scorer.restorer())
    assert plain >= toxicity.THRESHOLD and hidden >= plain - 1e-9
    assert scorer.score("the and of with that", scorer.restorer()) < 0.1


@pytest.mark.parametrize("written, meant", [
    ("you i d i o t.", "idiot"), ("i d i o t, you", "idiot"), ('"i d i o t"', "idiot"), ("(i d i o t)!", "idiot"), ("_l o s e r_ ...", "loser"),
    ("iddiot", "idiot"), ("Stuupid!", "stupid"), ("looser", "loser"), ("1d107", "idiot")])
def test_edges_and_doubled_letters_do_not_hide_a_word(scorer, written, meant):
    plain = scorer.score(meant, scorer.restorer())
    assert plain >= toxicity.THRESHOLD and scorer.score(written, scorer.restorer()) >= plain - 1e-9


def test_look_alikes_alone(scorer):
    bins = toxicity.Restorer(scorer.model)
    weights = {-1: -4.0} | {k: 8.0 for w in ("455", "@55", "10532") for k in bins.bins(toxicity.restore(w, scorer.model))}
    own = toxicity.Scorer(scorer.model, weights)
    for written in ("455", "@55", "@55!", "(10532)", "so 455, yes"):
        assert own.score(written, own.restorer()) > 0.9
    assert own.score("letter coffee 7 !!! ...", own.restorer()) < 0.1


def test_toxicity_edge_cases(spark, scorer):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a1" * 50_000, 3), (None, "*" * 500 + " b" * 2000, 4), (5, "é퟿ 1!1", 5)],
                               "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, scorer).collect()}
    assert got[1] == got[2] and all(0 <= v <= 1 for v in got.values()) and len(got) == 5
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    for d, y in ((df.drop("score"), labels), (df.drop("score").limit(0), labels.limit(0))):
        res = toxicity.score(d, toxicity.fit(d, y)).collect()
        assert all(r["score"] < toxicity.THRESHOLD for r in res)


def test_character_counts_cover_all_texts(spark):
    df = spark.createDataFrame([("ab ",), (None,), ("",), ("ab",), ("Ab!",)], "text string")
    n = toxicity.char_counts(df.repeat(1) if hasattr(df, "repeat") else df)
    assert sum(n.values()) == 6 and set(n.values()) == {3}


def test_held_out_matches_crc(spark):
    from feedlens.llm.common import held_out
    df = spark.createDataFrame([(i,) for i in [*range(-5, 60), None]], "doc_id long")
    assert all(r[1] == is_held_out(r[0]) for r in df.select("doc_id", held_out(F.col("doc_id"))).collect())


def test_letters_on_lines_of_their_own(scorer):
    plain = scorer.score("idiot", scorer.restorer())
    for written in ("i\nd\ni\no\nt", "you i\r\nd\r\ni\r\no\r\nt!", "a b\ni d\ti o\nt"):
        assert scorer.score(written, scorer.restorer()) >= (plain - 1e-9 if "a b" not in written else 0)


@pytest.mark.parametrize("token", ["1d10t", "i d i o t", "st*d", "iddiot", "l0$er", "a1!b", "m-o-r0n", "66", "x", "ssstt1", "(0)1"])
def test_restoring_equals_trying_every_path(scorer, token):
    """Viterbi's path is the best of all paths of the lattice, each scored by the definition."""
    from itertools import product
    model = scorer.model
    steps = toxicity._lattice(token) + [[(" ", 0.0)]]
    best, texts = None, set()
    for path in product(*steps):
        a = b = 0
        s = 0.0
        for letters, cost in path:
            s += cost
            for c in letters:
                k = toxicity.letter_class(c)
                if k == 0 and b == 0:
                    continue
                s += float(model.log[a, b, k])
                a, b = b, k
        text = "".join(x for x, _ in path).strip()
        if best is None or s > best + 1e-6:
            best, texts = s, {text}
        elif s > best - 1e-6:
            texts.add(text)
    assert toxicity.restore(token, model).replace(" ", "") in {t.replace(" ", "") for t in texts}


def test_regression_equals_a_plain_one():
    """Newton's method on the same words: the same probabilities."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(4)
    y = (rng.random(400) < .3).astype(int)
    bins = [np.array(sorted({k for k in range(6) if rng.random() < (.7 if bad and k < 3 else .15)})) for bad in y]
    got = {int(r.bin): r.weight for r in toxicity._fit(pd.DataFrame({"id": range(400), "y": y, "bins": bins})).itertuples()}
    used = sorted(k for k in got if k >= 0)
    assert set(used) >= {0, 1, 2}
    x = np.array([[1.0, *[k in set(b.tolist()) for k in used]] for b in bins])
    w = np.zeros(x.shape[1])
    ridge = np.r_[0.0, np.full(len(used), toxicity.PENALTY)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    mine = 1 / (1 + np.exp(-x @ np.array([got[-1], *[got[k] for k in used]])))
    assert np.abs(mine - 1 / (1 + np.exp(-x @ w))).max() < 0.01


def test_votes_and_margins_by_a_plain_loop(spark, docs):
    """The language picked is that of the definition: family of the highest margin, then votes, margins, name."""
    models = langid.fit(docs, per_lang=60)
    for text in ["the cat and the dog", "der Hund und die Katze", "el perro y el gato", "le chien et le chat", "x", "zzz qqq", "1 a", "und the y le"]:
        f = langid.features(text)
        margin = lambda *key: float(models.weights[models.at[key]][:-1] @ f + models.weights[models.at[key]][-1])
        family = max(models.families, key=lambda g: margin("family", g, ""))
        tally = {}
        for g in models.members[family]:
            ms = [margin("pair", g, o) if ("pair", g, o) in models.at else -margin("pair", o, g) for o in models.members[family] if o != g]
            wins = sum((("pair", g, o) in models.at and margin("pair", g, o) >= 0) or (("pair", o, g) in models.at and margin("pair", o, g) < 0)
                       for o in models.members[family] if o != g)
            tally[g] = (-wins, -sum(ms), g)
        assert models.predict(text)[0] == min(tally, key=tally.get)


def test_many_languages_and_repeated_rows(spark, monkeypatch):
    """As many tags as there may be: each is learned from fewer texts, none is refused; repeated rows come back repeatedly."""
    monkeypatch.setattr(langid, "TRAIN_TEXTS", 300)
    ids = [i for i in range(4000) if not is_held_out(i)]
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}x" for j in range(6))
    rows = [(i, words(n % 300), f"l{n % 300:03d}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(df.where("lang < 'l040'"))
    assert len(models.langs) == 40 and models.predict(words(3))[0] == "l003"
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 3)
    assert langid.fit(df.where("lang < 'l040'")).langs == models.langs
    monkeypatch.setattr(langid, "STEPS", 1)
    assert len(langid.fit(df).langs) == 300
    twice = df.limit(5).unionByName(df.limit(5))
    assert langid.identify(twice, models).count() == 10
    plan = langid.identify(twice, models)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan


def test_repeated_ids_of_toxicity(spark, scorer):
    rows = [(1, "you idiot"), (1, "you idiot"), (1, "the sea"), (None, "you idiot"), (None, "you idiot")]
    got = sorted((str(r["doc_id"]), r["text"], round(r["score"], 6)) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect())
    assert len(got) == 5 and len({s for _, t, s in got if t == "you idiot"}) == 1


def test_words_without_weight_are_not_decoded(monkeypatch):
    """Tokens none of whose readings weighs anything are left out undecoded; the bins are those of decoding all."""
    import random
    from collections import Counter

    import numpy as np
    from feedlens.llm.chars import trigrams

    counts = Counter()
    for t in ["you idiot", "a letter and a coffee", "the looser hello book", "stupid", "été allée"]:
        counts.update(trigrams(t).tolist())
    model = toxicity.CharModel(counts)
    wanted = np.zeros(toxicity.BINS, dtype=bool)
    wanted[[zlib.crc32(w.encode()) % toxicity.BINS for w in ("idiot", "loser", "allée", "letter")]] = True
    rng, signs = random.Random(5), "aeilorstéª€ℂ漢0135@$!*.-_ \n\x1c"
    odd = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(2000)]
    texts = ["iddiot 1d10t (looser) l e t t e r. allééée!", "\ud800 id*ot \"l o s e r\"", None, "", " ".join(odd), *odd]
    plain, own = toxicity.Restorer(model), toxicity.Restorer(model, wanted)
    assert [own.bins(t) for t in texts] == [{k for k in plain.bins(t) if wanted[k]} for t in texts] and len(own.bins(texts[0])) == 3

    decoded, decode = [], toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda token, m: decoded.append(token) or decode(token, m))
    own = toxicity.Restorer(model, wanted)
    assert not own.bins("coffee, hello books; mississippi bookkeeper 100 2.5 naïïve 3a") and not decoded
    own.bins("iddiot coffee")
    assert decoded == ["iddiot"]
