"""Language identification in two steps: family first, then one against one.

A text's features are the square roots of its hashed character trigram counts,
scaled to length 1. Linear support vector machines (squared hinge) are fitted
on a bounded sample: one per language family against the rest, and within a
family one per pair of languages. A text goes to the family of the highest
margin; there each pair casts a vote, ties go to the larger sum of margins,
then to the smaller name.

The sample - about ``PER_LANG`` texts of each language, and about
``TRAIN_TEXTS`` in all, drawn by a hash of the id - is fitted in one task that
gets the texts' features; the models (a few KB each) are the only thing that
reaches the driver. Texts that are not drawn are not sent anywhere. Prediction
is one pass over the whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.chars import trigrams
from feedlens.llm.common import frozen, held_out

BINS = 1 << 13
#: Bound of the training sample: expected texts per language, and in all (at least ``LEAST_PER_LANG`` of each language).
PER_LANG, TRAIN_TEXTS, LEAST_PER_LANG = 600, 9600, 4
#: The counts (a row per language) are broadcast up to so many languages; beyond, rows are joined by language.
BROADCAST_LANGS = 10_000
#: Squared-hinge training: weight of the losses and steps.
PENALTY, STEPS = 100.0, 150
UNDETERMINED = "und"

# Language families by ISO 639-1 code; a language that is not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"={lang}")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    codes = trigrams(text)
    x = np.sqrt(np.bincount((codes * 2654435761 >> 7) % BINS, minlength=BINS)).astype(np.float32)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + PENALTY mean max(0, 1 - y (w x + b))^2,
    both classes weighing the same, by accelerated gradient steps."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * PENALTY
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    v, t = w.copy(), 1.0
    step = 1.0 / (1.0 + 4.0 * PENALTY)  # rows have length 1, and 1 more for the bias
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * cost
        grad = np.r_[v[:-1] - 2 * (slack @ x), -2 * slack.sum()].astype(np.float32)
        new = v - step * grad
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + np.float32((before - 1) / t) * (new - w)
        w = new
    return w


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    """Rows (kind, pos, neg, weights): the models of one training sample (lang, bins, values: the features of a text)."""
    sample = sample.sort_values(["lang", "h"])  # the same sum in any order of arrival
    langs = sorted(sample["lang"].unique())
    families = sorted({family_of(x) for x in langs})
    lang = sample["lang"].to_numpy()
    family = np.array([family_of(x) for x in lang])
    x = np.zeros((len(sample), BINS), dtype=np.float32)
    for row, bins, values in zip(x, sample["bins"], sample["vals"]):
        row[bins] = values
    rows = [("lang", g, "", b"") for g in langs]
    if len(families) > 1:
        rows += [("family", f, "", _svm(x, np.where(family == f, 1, -1).astype(np.float32)).tobytes()) for f in families]
    for a, b in combinations(langs, 2):
        if family_of(a) == family_of(b):
            own = (lang == a) | (lang == b)
            rows.append(("pair", a, b, _svm(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32)).tobytes()))
    return pd.DataFrame(rows, columns=["kind", "pos", "neg", "weights"])


class Models:
    """Fitted models; picks the language of one text."""

    def __init__(self, rows: list[tuple[str, str, str, bytes]]):
        self.langs = sorted(r[1] for r in rows if r[0] == "lang")
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [g for g in self.langs if family_of(g) == f] for f in self.families}
        keyed = [((k, a, b), np.frombuffer(w, dtype=np.float32)) for k, a, b, w in rows if k != "lang"]
        self.at = {key: i for i, (key, _) in enumerate(keyed)}
        self.weights = np.stack([w for _, w in keyed]) if keyed else np.zeros((0, BINS + 1), dtype=np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.langs:
            return UNDETERMINED, 0.0
        margins = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            m = [margins[self.at["family", f, ""]] for f in self.families]
            order = np.argsort(m)[::-1]
            family, sure = self.families[order[0]], _sigmoid(2 * (m[order[0]] - m[order[1]]))
        votes = {g: [0, 0.0] for g in self.members[family]}
        least = dict.fromkeys(votes, np.inf)
        for a, b in combinations(self.members[family], 2):
            d = margins[self.at["pair", a, b]]
            votes[a if d >= 0 else b][0] += 1
            for g, m in ((a, d), (b, -d)):
                votes[g][1] += m
                least[g] = min(least[g], m)
        best = min(votes, key=lambda g: (-votes[g][0], -votes[g][1], g))
        return best, float(min(1.0, max(0.0, sure * (1.0 if np.isinf(least[best]) else _sigmoid(4 * least[best])))))


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Models:
    """Models from the rows of ``docs`` that have a language, an id and a letter in the text, but for held-out ids."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))))
    counts = frozen(rows.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")))
    langs = counts.count()
    per_lang = min(per_lang, max(LEAST_PER_LANG, TRAIN_TEXTS // max(1, langs)))
    if langs <= BROADCAST_LANGS:  # the texts stay where they are
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = (rows.filter(F.col("text").rlike(r"\p{L}")).join(counts, F.col("lang") == F.col("l"))
             .filter(draw * F.col("n") < per_lang).select("text", "lang"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = [features(t) for t in df["text"]]
            bins = [np.flatnonzero(v) for v in x]
            yield pd.DataFrame({"lang": df["lang"], "h": [zlib.crc32(t.encode("utf-8", "replace")) for t in df["text"]],
                                "bins": [b.astype(np.int32) for b in bins], "vals": [v[b] for v, b in zip(x, bins)]})

    sample = drawn.mapInPandas(featured, "lang string, h long, bins array<int>, vals array<float>")
    models = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "kind string, pos string, neg string, weights binary")
    return Models([tuple(r) for r in models.collect()])


def identify(docs: DataFrame, models: Models, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a confidence from 0 to 1 added.

    Null texts and texts without a letter get ``und`` and 0, as does every text
    if nothing could be learned; whole texts count, however long. Columns of
    ``docs`` that have the names in ``out`` are replaced.
    """
    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([models.predict(t) for t in s], columns=["lang", "score"])

    got = docs.withColumn("_lid", predict(F.col(text_col)))
    return got.withColumns({out[0]: F.col("_lid.lang"), out[1]: F.col("_lid.score")}).drop("_lid")
