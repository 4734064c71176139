"""Toxicity of texts, with noisy-channel restoration of disguised words.

1. A character trigram model is counted over all documents (one pass; each
   task adds up its own counts, so the exchange is bounded by the model).
2. Disguised words - letters mixed with look-alike signs, look-alikes alone,
   doubled and stretched letters, letters set apart by spaces, lines or signs - become
   a lattice: every sign may stand for some letters at a cost, a doubled or
   stretched letter for one or two, a separator for nothing. Viterbi decoding
   finds the path that channel and trigram model like best; the restored word
   counts next to the written one.
3. A logistic regression over the distinct restored words (hashed) is fitted
   in one task on a bounded sample of labelled rows, and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.chars import CLASSES, letter_class, trigrams
from feedlens.llm.common import held_out

BINS = 1 << 18
#: Bound of the training sample: expected labelled texts.
TRAIN_DOCS = 12_000
#: A word takes part if so many toxic texts of the sample have it, and its log odds are so many standard errors above 0.
MIN_DOCS, SURE = 3, 3.0
PENALTY, STEPS = 0.02, 1000
THRESHOLD = 0.7

# Letters a sign may stand for. Fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c"}
WILDCARDS = "*#"
SEPARATORS = ".-_~'`^,;:/\\"
ANY_LETTER = "abcdefghijklmnopqrstuvwxyz"
#: Log costs of the channel: a look-alike, a wildcard, a dropped sign, a stretched letter meant twice, a doubled one meant once, a boundary.
SIGN, WILD, DROP, TWICE, ONCE, SPLIT = -1.5, -2.5, -0.7, -0.7, -6.0, -3.0
#: Decoded words remembered per task; then the memory starts anew.
REMEMBER = 150_000
#: Readings of a token that are looked up before it is decoded; one with more is decoded at once.
READINGS = 64

_EDGE = ".,;:!?\"'()[]{}<>«»…–—-&%#*=_/\\|~`^"
_DISGUISED = re.compile(r"[^\W\d_].*[0-9@$!|+(<€£¢*#.\-_~'`^,;:/\\]|[0-9@$!|+(<€£¢*#].*[^\W\d_]|([^\W\d_])\1"
                        r"|[0-9@$€£¢].*[0-9@$!|+(<€£¢]|[!|+(<].*[0-9@$€£¢]", re.S)  # the last line: look-alikes alone
_RUNS, _REPEATS = re.compile(r"((.)\2*)", re.S), re.compile(r"((.)\2+)", re.S)
_SPACED = re.compile(r"(?<!\S)(?:[^\w\s]|_)*([\w@$!|+(<€£¢*#](?:[ \t\r\n]+[\w@$!|+(<€£¢*#]){2,})(?:[^\w\s]|_)*(?!\S)")
#: The last but one sign of a spaced word and what follows it; a text without has no spaced word.
_SPACED_END = re.compile(r"[ \t\r\n][\w@$!|+(<€£¢*#](?=[ \t\r\n]+[\w@$!|+(<€£¢*#](?:[^\w\s]|_)*(?!\S))")


class CharModel:
    """log P(c | a, b) of character classes: trigram counts over bigram counts over letter counts."""

    def __init__(self, counts: dict[int, int]):
        n = np.zeros(CLASSES ** 3)
        n[np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))] = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        tri = n.reshape(CLASSES, CLASSES, CLASSES)
        uni = (tri.sum(axis=(0, 1)) + 1) / (tri.sum() + CLASSES)
        two = tri.sum(axis=0)
        bi = (two + 5 * uni) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((tri + 5 * bi) / (tri.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def char_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Trigram counts of all texts: at most CLASSES ** 3 entries, whatever the corpus."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for df in batches:
            for t in df["t"]:
                codes = trigrams(t)
                if len(codes) > 20_000:
                    total += np.bincount(codes, minlength=len(total))
                else:
                    np.add.at(total, codes, 1)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"code": some, "n": total[some]})

    texts = docs.select(F.col(text_col).alias("t")).filter("t IS NOT NULL")
    sums = texts.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in sums.collect()}


@lru_cache(maxsize=1 << 14)
def _step(run: str) -> list[tuple[str, float]]:
    """The strings that a run of equal characters may stand for, with their costs; three stand for longer runs."""
    c, n = run[0], len(run)
    if c == " ":
        return [("", DROP), (" ", SPLIT)]
    if c in SEPARATORS:
        return [("", DROP)]
    if c in WILDCARDS:
        return [("", DROP)] + ([(x, WILD) for x in ANY_LETTER] if n <= 2 else [])
    if c in LOOKALIKES:
        once, twice = ((0.0, None), (ONCE, SIGN), (0.0, TWICE))[min(n, 3) - 1]
        return ([(x, SIGN + once) for x in LOOKALIKES[c]]
                + ([(x + x, SIGN + twice) for x in LOOKALIKES[c]] if n > 1 else [])
                + ([] if c.isalnum() or c in "@$" else [("", DROP)]))
    if not letter_class(c):
        return [("", DROP)]
    if n == 1:
        return [(c, 0.0)]
    if n == 2:
        return [(c + c, 0.0), (c, ONCE)]
    return [(c, 0.0), (c + c, TWICE)]


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters the strings it may stand for, with their costs."""
    return [_step(run[:3]) for run, _ in _RUNS.findall(token)]


def restore(token: str, model: CharModel) -> str:
    """The likeliest letters behind a lower-cased token (Viterbi over its lattice); '' if none."""
    states = {(0, 0): (0.0, None)}  # the last two classes -> (log probability, (earlier path, letters))
    for step in _lattice(token) + [[(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in step:
                x, y, s = a, b, score + cost
                for c in letters:
                    k = letter_class(c)
                    if k == 0 and y == 0:  # no boundary behind a boundary
                        continue
                    s += model.log[x, y, k]
                    x, y = y, k
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (path, letters) if letters else path)
        states = new
    path = max(states.values(), key=lambda v: v[0])[1]
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts)).strip()


class _Known(dict):
    """Bins of tokens, found when first asked for and remembered."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self._find = find

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= REMEMBER:
            self.clear()
        got = self[token] = self._find(token)
        return got


class Restorer:
    """Bins of the distinct words, as written and restored, of texts; remembers the bins of tokens.

    ``wanted`` (a mask over the bins) leaves out words that weigh nothing. A token
    all of whose readings weigh nothing need not be decoded: whichever is the
    likeliest, its bin is left out.
    """

    def __init__(self, model: CharModel, wanted: np.ndarray | None = None):
        self.model, self.known, self.spaced = model, _Known(self._token), _Known(self._spaced)
        self.wanted = b"\1" * BINS if wanted is None else wanted.astype(np.uint8).tobytes()
        self.all = 0 not in self.wanted

    def _bins(self, words: set[str]) -> tuple[int, ...]:
        found = {zlib.crc32(w.encode("utf-8", "replace")) % BINS for w in words if w}
        return tuple(k for k in found if self.wanted[k])

    def _weighs(self, token: str) -> bool:
        """False if no reading of a token without blanks is wanted."""
        if self.all:
            return True
        readings, parts = [""], _REPEATS.split(token)  # single characters, a run, its character, single characters, ...
        for singles, run in zip(parts[::3], [*parts[1::3], ""]):
            if singles.isascii() and singles.isalpha():
                steps = [[(singles, 0.0)]]
            else:
                steps = [_step(c) for c in singles]
            if run:
                steps.append(_step(run[:3]))
            for step in steps:
                if len(readings) * len(step) > READINGS:
                    return True
                readings = [r + more for r in readings for more, _ in step]
        return any([self.wanted[zlib.crc32(r.encode("utf-8", "replace")) % BINS] for r in readings])

    def _token(self, token: str) -> tuple[int, ...]:
        bare = token.strip(_EDGE)
        if bare.isalpha() and not _REPEATS.search(bare):
            k = zlib.crc32(bare.encode("utf-8", "replace")) % BINS
            return (k,) if self.wanted[k] else ()
        ends = token.rstrip(".,;:?\"')]}").lstrip("\"'([{")  # signs that end it may be letters
        return self._bins({bare, *(w for t in {bare, ends} if (t.isalpha() or _DISGUISED.search(t)) and self._weighs(t)
                                   for w in restore(t, self.model).split())})

    def _spaced(self, spaced: str) -> tuple[int, ...]:
        return self._bins({w for w in restore(spaced, self.model).split() if len(w) > 1})

    def bins(self, text: str | None) -> set[int]:
        if not text:
            return set()
        low = text.lower()
        found = set().union(*filter(None, map(self.known.__getitem__, set(low.split()))))
        if _SPACED_END.search(low):
            for m in _SPACED.finditer(low):
                found.update(self.spaced[" ".join(m.group(1).split())])
        return found


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    """(bin, weight) of a logistic regression on the presence of telling words, bin -1 the bias.

    A word is telling if its log odds of being in a toxic text rather than
    another exceed 0 by ``SURE`` standard errors. Ridge penalty PENALTY.
    """
    sample = sample.sort_values("id")
    y = sample["y"].to_numpy(dtype=np.float64)
    rows = [np.asarray(b, dtype=np.int64) for b in sample["bins"]]
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, bad = len(rows), y.sum()
    t = np.bincount(flat, weights=y[doc], minlength=BINS)
    c = np.bincount(flat, minlength=BINS) - t
    odds = np.log((t + 0.5) / (bad - t + 0.5)) - np.log((c + 0.5) / (n - bad - c + 0.5))
    telling = (t >= MIN_DOCS) & (odds > SURE * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))
    used = np.flatnonzero(telling)
    at = np.cumsum(telling) - 1
    keep = telling[flat]
    col, doc = at[flat[keep]], doc[keep]
    w, b = np.zeros(len(used)), float(np.log((bad + 1) / (n - bad + 1)))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, STEPS + 1):  # Adam steps on the penalised log loss
        z = b + np.bincount(doc, weights=w[col], minlength=n)
        r = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g, gb = np.bincount(col, weights=r[doc], minlength=len(used)) + PENALTY * w, r.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.3 / np.sqrt(i)
        w -= rate * (m / (1 - 0.9 ** i)) / (np.sqrt(s / (1 - 0.99 ** i)) + 1e-9)
        b -= rate * (mb / (1 - 0.9 ** i)) / (np.sqrt(sb / (1 - 0.99 ** i)) + 1e-9)
    return pd.DataFrame({"bin": np.r_[-1, used].astype(np.int64), "weight": np.r_[b, w]})


class Scorer:
    """Fitted toxicity model."""

    def __init__(self, model: CharModel, weights: dict[int, float]):
        self.model = model
        self.bias = weights.get(-1, -4.0)  # nothing learned: every text scores low
        self.weights = np.zeros(BINS)
        for k, v in weights.items():
            if k >= 0:
                self.weights[k] = v

    def restorer(self) -> Restorer:
        return Restorer(self.model, self.weights != 0)

    def score(self, text: str | None, restorer: Restorer) -> float:
        z = self.bias + sum(self.weights[k] for k in sorted(restorer.bins(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_docs: int = TRAIN_DOCS) -> Scorer:
    """A scorer from the labelled rows whose id is not held out.

    Null ids and labels teach nothing; an id with several labels counts as
    toxic if one is. The character model is counted over all of ``docs``.
    """
    model = CharModel(char_counts(docs, text_col))
    marked = (labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).dropna()
              .filter(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("y").alias("y")))
    total = marked.count()
    draw = F.pmod(F.xxhash64(F.col("l_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    marked = marked.filter(draw * total < train_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("array<int>")
    def bins(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model)
        for s in texts:
            yield pd.Series([np.array(sorted(restorer.bins(t)), dtype=np.int32) for t in s])

    sample = rows.join(marked, F.col("id") == F.col("l_id")).select("id", "y", bins("text").alias("bins"))
    weights = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "bin long, weight double")
    return Scorer(model, {r["bin"]: r["weight"] for r in weights.collect()})


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) of each whole text added; null and empty texts score as
    texts without words. A column of ``docs`` called ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # of fixed size: BINS weights and CLASSES ** 3 logs

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        restorer = own.restorer()
        for s in texts:
            yield pd.Series([own.score(t, restorer) for t in s], dtype=float)

    return docs.withColumn(out, scored(F.col(text_col)))
