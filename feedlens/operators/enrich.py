"""Model-assisted enrichment and digests.

The model is a caller-supplied function; Spark runs it in Arrow batches
through ``mapInPandas`` (never row at a time) and everything around it
(selection of pending rows, normalisation, numbering, joins) stays in
native expressions.
"""

from __future__ import annotations

import json
import uuid
import zlib
from typing import Callable, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema as S
from feedlens.functions.analysis import normalize_analysis
from feedlens.functions.scalars import day, label_or
from feedlens.plans.ranking import prefix_sum_within
from feedlens.session import Written, checkpoint_dir, frozen, short_shuffles, written

Scorer = Callable[[pd.Series], pd.Series]


# ---- E1/E3: classification --------------------------------------------------------
def keyword_response_scorer(texts: pd.Series) -> pd.Series:
    """E3 as a model stand-in: answers what a model would, as JSON text:
    the keyword tag of the text, sentiment 0, urgency 0.2, empty summary."""
    low = texts.fillna("").str.lower()
    answers = {name: json.dumps({"tag": name, "sentiment": 0, "urgency": 0.2, "summary": ""})
               for name in [*(n for n, _ in S.TAG_KEYWORDS), "Other"]}
    out = pd.Series(answers["Other"], index=texts.index)
    done = pd.Series(False, index=texts.index)
    for name, words in S.TAG_KEYWORDS:
        hit = pd.Series(False, index=texts.index)
        for w in words:
            hit |= low.str.contains(w, regex=False)
        out = out.mask(hit & ~done, answers[name])
        done |= hit
    return out


def classify(df: DataFrame, scorer: Scorer, text_col: str = "text", id_col: str = "id",
             pending_only: bool = True) -> DataFrame:
    """(id, raw_response) for rows to classify (default: ``analyzed_at`` null).

    Only the id and the text cross into Python. If the call for a batch
    raises, its texts are scored one by one, and those that raise alone get
    null responses: only they stay pending, as in the reference.
    """
    src = df.where(F.col("analyzed_at").isNull()) if pending_only and "analyzed_at" in df.columns else df
    src = src.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def alone(text):
        try:
            return list(scorer(pd.Series([text])))[0]
        except Exception:  # model failure: leave the row pending
            return None

    def run(batches):
        for pdf in batches:
            try:
                raw = pd.Series(scorer(pdf["text"]), index=pdf.index).astype(object)
            except Exception:
                raw = pd.Series([alone(t) for t in pdf["text"]], index=pdf.index, dtype=object)
            yield pd.DataFrame({"id": pdf["id"], "raw_response": raw.where(raw.notna(), None)})

    return src.mapInPandas(run, "id long, raw_response string")


def analyze(df: DataFrame, scorer: Scorer, **kw) -> DataFrame:
    """E1+E2: classify and normalise -> (id, tag, sentiment, urgency_score, summary)."""
    return normalize_analysis(classify(df, scorer, **kw)).drop("raw_response")


# ---- E4: narrative input --------------------------------------------------------------
def narrative_input(df: DataFrame, limit: int = S.LATEST_ANALYZED_LIMIT) -> DataFrame:
    """JSON array of the latest analysed rows ``[{text, tag, sentiment}]``,
    newest first - bounded by ``limit`` before anything is collected."""
    top = (df.where(F.col("analyzed_at").isNotNull())
           .select("id", "text", "tag", "sentiment", "analyzed_at")
           .orderBy(F.col("analyzed_at").desc(), F.col("id").desc()).limit(int(limit)))
    key = F.struct("analyzed_at", "id", "text", "tag", "sentiment")
    arr = F.sort_array(F.collect_list(key), asc=False)  # newest first, then higher id
    return top.agg(F.to_json(F.transform(arr, lambda x: F.struct(x["text"].alias("text"), x["tag"].alias("tag"),
                                                                  x["sentiment"].alias("sentiment")))).alias("input"))


# ---- A12/E5: daily digests --------------------------------------------------------
def _cut(max_chars: int):
    """Rows sorted by day and line -> chunks of a day's consecutive lines, numbered within this task's part of the day.

    A chunk ends before the line at which the characters of the day's earlier
    lines in this task pass the next multiple of ``max_chars``. Texts and tags
    are passed on as slices of the batches they came in."""
    names = ["date", "slice", "chunk", "first", "count", "chars", "before", "tags", "texts"]

    def lists(parts: list[list[pa.Array]]) -> pa.ListArray:
        sizes = [sum(map(len, p)) for p in parts]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.concat_arrays([x for p in parts for x in p]))

    def batch(chunks: list[dict]) -> pa.RecordBatch:
        plain = [pa.array([c[k] for c in chunks], t) for k, t in zip(names[:6], [pa.date32(), pa.int32(), *[pa.int64()] * 4])]
        return pa.RecordBatch.from_arrays(plain + [lists([c[k] for c in chunks]) for k in names[6:]], names)

    def run(batches):
        part, day_, line, chars, chunk, held = TaskContext.get().partitionId(), None, 0, 0, 0, None
        for b in batches:
            done = []
            dates, weights = b.column("date").cast(pa.int32()).to_numpy(), b.column("w").to_numpy()
            starts = np.flatnonzero(np.r_[True, dates[1:] != dates[:-1]]) if len(dates) else []
            for lo, hi in zip(starts, [*starts[1:], len(dates)]):
                if dates[lo] != day_:
                    day_, line, chars, chunk = dates[lo], 0, 0, 0
                before = chars + np.cumsum(weights[lo:hi]) - weights[lo:hi]
                window = before // max_chars
                cuts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
                for x, y in zip(cuts, [*cuts[1:], hi - lo]):
                    key = (int(day_), int(window[x]))
                    if held is None or held["key"] != key:
                        if held is not None:
                            done.append(held)
                        held = {"key": key, "date": int(day_), "slice": part, "chunk": chunk, "first": line + int(x), "count": 0, "chars": 0,
                                "before": [], "tags": [], "texts": []}
                        chunk += 1
                    held["count"] += int(y - x)
                    held["chars"] += int(weights[lo + x:lo + y].sum())
                    held["before"].append(pa.array(before[x:y]))
                    held["tags"].append(b.column("tag").slice(lo + x, y - x))
                    held["texts"].append(b.column("text").slice(lo + x, y - x))
                line, chars = line + int(hi - lo), int(before[-1] + weights[hi - 1])
            if done:
                yield batch(done)
        if held is not None:
            yield batch([held])

    return run


def _line_weight(tag, text):
    return (F.length(text) + F.length(tag) + S.DIGEST_LINE_OVERHEAD).cast("long")


class DigestChunks:
    """The day's lines, placed once: ``rows`` (date, slice, chunk, first, count, chars, before, tags, texts) is a stored
    table of chunks of consecutive lines, ``offsets`` tells what the day has before each slice.

    One range exchange on (date, created_at, id) brings every text to its
    place; tasks cut their sorted rows into chunks, and a busy day lies in as
    many slices as it needs. Lines, characters and chunks before a slice come
    from the counts of the stored chunks, without their texts.
    """

    def __init__(self, df: DataFrame, max_chars: int = S.DIGEST_PROMPT_CHARS):
        label = label_or("tag", "Unknown")
        text = F.coalesce(F.col("text"), F.lit(""))
        src = df.select(day("created_at").alias("date"), "created_at", "id", label.alias("tag"), text.alias("text"), _line_weight(label, text).alias("w"))
        keys = [F.col("date").asc(), F.col("created_at").desc(), F.col("id").desc()]
        placed = src.where(F.col("date").isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        schema = "date date, slice int, chunk long, first long, count long, chars long, before array<long>, tags array<string>, texts array<string>"
        self.rows = written(placed.select("date", "tag", "text", "w").mapInArrow(_cut(int(max_chars)), schema), "digest-chunks")
        before = Window.partitionBy("date").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.rows.groupBy("date", "slice").agg(F.sum("count").alias("lines"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("chunks"))
        self.offsets = frozen(counts.select(
            F.col("date").alias("o_date"), F.col("slice").alias("o_slice"), "chunks",
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in ("lines", "chars", "chunks")]))

    def numbered(self) -> DataFrame:
        """``rows`` with the day's lines, characters and chunks before the slice. The offsets are broadcast: at most a row for each
        slice (task) and one for each date more."""
        same = (F.col("date") == F.col("o_date")) & (F.col("slice") == F.col("o_slice"))
        return self.rows.join(F.broadcast(self.offsets.drop("chunks")), same).drop("o_date", "o_slice")

    def most_chunks(self) -> int:
        """Chunks of the busiest day; one number to the driver."""
        return self.offsets.agg(F.max(F.col("o_chunks") + F.col("chunks"))).first()[0] or 0


def _line(number, tag, text):
    return F.concat(number.cast("string"), F.lit(". ["), tag, F.lit("] "), text)


def digest_lines(df: DataFrame, dates: list[str] | None = None, rows_of: Callable[[DataFrame], DataFrame] | None = None,
                 same_text: bool = False) -> DataFrame:
    """A12 long form: (date, line_no, line, chars_before) with
    ``i. [tag or Unknown] text``, numbered from 1 per creation day, newest
    first (ties: higher id first). ``chars_before`` is the weight of the
    day's earlier lines (text + tag label + DIGEST_LINE_OVERHEAD each).

    Numbers and weights come from one range-partitioned prefix pass on (date,
    created_at, id) only, so one very busy day is spread over many tasks; the
    full texts are joined to them by id, the one exchange that carries text.
    Where ``df`` is a view that joins the texts itself, ``rows_of(numbers)`` can
    give its rows joined by id with the frame ``numbers`` before that, so that
    no exchange carries a text; the rows are the same. Rows that share an id all
    meet its numbers; with ``same_text`` a number meets only rows of the text and tag it was given for.
    ``id`` must be unique; rows without a creation time belong to no day.
    """
    nums = _line_numbers(df, dates, same_text).drop("_ln_d")
    if rows_of is None:
        numbered = _lines_of(df, dates).join(nums, F.col("id") == F.col("_ln_id"))
    else:
        numbered = _lines_of(rows_of(nums.withColumnRenamed("_ln_id", "id")), dates, *[c for c in nums.columns if c != "_ln_id"])
    return _numbered_lines(numbered, same_text)


def _lines_of(rows: DataFrame, dates: list[str] | None = None, *more: str) -> DataFrame:
    src = rows.select(day("created_at").alias("date"), "id", "created_at", label_or("tag", "Unknown").alias("tag"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"), *more).where(F.col("date").isNotNull())
    return src.where(F.col("date").isin([F.lit(d).cast("date") for d in dates])) if dates else src


def _shown():
    return F.xxhash64("tag", "text")


def _line_numbers(df: DataFrame, dates: list[str] | None = None, same_text: bool = False) -> DataFrame:
    """The lines' numbers (_ln_id, _ln_d: its day, line_no, chars_before) and, with ``same_text``, a hash of what they show (_ln_h)."""
    keys = _lines_of(df, dates).select("date", "id", "created_at", _line_weight(F.col("tag"), F.col("text")).alias("_ln_w"), *([_shown().alias("_ln_h")] if same_text else []))
    nums = prefix_sum_within(keys, ["date"], [F.col("created_at").desc(), F.col("id").desc()], weight="_ln_w", out="chars_before", count_out="_ln_0")
    return nums.select(F.col("id").alias("_ln_id"), F.col("date").alias("_ln_d"), (F.col("_ln_0") + 1).cast("long").alias("line_no"), F.col("chars_before").cast("long"),
                       *(["_ln_h"] if same_text else []))


def _numbered_lines(numbered: DataFrame, same_text: bool) -> DataFrame:
    numbered = numbered.where(_shown() == F.col("_ln_h")) if same_text else numbered
    return numbered.select("date", "line_no", _line(F.col("line_no"), F.col("tag"), F.col("text")).alias("line"), "chars_before")


@F.pandas_udf(T.BinaryType())
def _packed(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: zlib.compress(x.encode(), 1))


class Generator(Protocol):
    """The model behind daily digests. A day is written in parts, each from a
    bounded prompt, and the parts are merged into one text; a day of one part
    needs no merge."""

    def write(self, date: str, prompt: str) -> str: ...

    def merge(self, date: str, parts: list[str]) -> str: ...


class LineCounter:
    """Deterministic stand-in for the model (tests, benchmarks): items and
    characters of the day's lines, the same however the day is cut."""

    def write(self, date: str, prompt: str) -> str:
        return f"{date}: {prompt.count(chr(10)) + 1} items, {len(prompt)} characters"

    def merge(self, date: str, parts: list[str]) -> str:
        found = [[int(w) for w in p.split(": ")[1].split() if w.isdigit()] for p in parts]
        # the line feeds between two parts are in neither
        return f"{date}: {sum(n for n, _ in found)} items, {sum(c for _, c in found) + len(parts) - 1} characters"


def _prompts(chunks: DigestChunks) -> DataFrame:
    start = F.col("o_lines") + F.col("first") + 1
    lines = F.transform(F.arrays_zip("tags", "texts"), lambda x, i: _line(start + i, x["tags"], x["texts"]))
    return chunks.numbered().select("date", (F.col("o_chunks") + F.col("chunk")).alias("chunk"), F.array_join(lines, "\n").alias("prompt"), "count")


def digest_prompts(df: DataFrame, max_chars: int = S.DIGEST_PROMPT_CHARS) -> DataFrame:
    """Prompt text per (date, chunk): the day's lines joined by newlines in order.

    A day is cut into chunks 0, 1, ... of consecutive lines with at most
    ``max_chars`` plus one line each, so no group and no cell grows with a
    busy day. No line is dropped.
    """
    return _prompts(DigestChunks(df, max_chars))


#: Characters of the days' lines that are on their way to prompts at once, about, and the most passes for that.
SLICE_CHARS, MAX_SLICES = 16_000_000_000, 16

#: Parts that one merge takes; the merges of a day are merged again, until one is left.
MERGE_PARTS = 64


def _slices(numbers: DataFrame) -> int:
    """Passes in which the lines of ``numbers`` go to their prompts; one number to the driver."""
    days = numbers.groupBy("_ln_d").agg(F.max("chars_before").alias("chars"))
    return min(MAX_SLICES, max(1, -(-(days.agg(F.sum("chars")).first()[0] or 0) // SLICE_CHARS)))


def daily_digest(df: DataFrame, generator: Generator, dates: DataFrame | None = None,
                 max_chars: int = S.DIGEST_PROMPT_CHARS, rows_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """E5: (date, summary, count), one row per date, however busy.

    Each prompt of ``digest_prompts`` is written by one call of
    ``generator.write``; the parts of a day are merged in order, ``MERGE_PARTS``
    at a time, on as many levels as the busiest day needs. If a call fails, the day's summary is its
    ``Error generating summary: ...``. Dates asked for (``dates`` frame with a
    ``date`` column) that have no feedback get ``No feedback received on D.``
    and count 0.

    With ``rows_of`` (see ``digest_lines``) the lines are numbered before they
    have texts; then each goes to its prompt at once, packed, and no chunk is stored.
    Of many lines those of some prompts (picked by a hash of day and chunk) go at a time,
    so that the exchange holds about ``SLICE_CHARS`` or, beyond ``MAX_SLICES``
    passes, a share of all; what the generator wrote is stored.
    """
    def called(f, date, x):
        try:
            return None, str(f(str(date), x))
        except Exception as err:  # the reference returns the error as text
            return f"Error generating summary: {err}", None

    def write(batches):
        for pdf in batches:
            if "prompt" in pdf:
                prompts, counts = pdf["prompt"], pdf["count"]
            else:  # rows that are alike meet each other's numbers: a line of each number
                first = [np.unique(np.asarray(n), return_index=True)[1] for n in pdf["numbers"]]
                prompts = ("\n".join(zlib.decompress(lines[i]).decode() for i in own) for lines, own in zip(pdf["lines"], first))
                counts = [len(own) for own in first]
            out = [called(generator.write, d, p) for d, p in zip(pdf["date"], prompts)]
            yield pd.DataFrame({"date": pdf["date"], "chunk": pdf["chunk"], "error": [e for e, _ in out],
                                "summary": [s for _, s in out], "count": counts})

    def merge(batches):
        for pdf in batches:
            out = [(e, None) if e is not None else (None, s[0]) if len(s) == 1 else called(generator.merge, d, list(s))
                   for d, e, s in zip(pdf["date"], pdf["error"], pdf["parts"])]
            yield pd.DataFrame({"date": pdf["date"], "chunk": pdf["chunk"], "error": [e for e, _ in out],
                                "summary": [s for _, s in out], "count": pdf["count"]})

    schema = "date date, chunk long, error string, summary string, count long"
    if rows_of is None:
        chunks = DigestChunks(df, max_chars)
        parts, left = _prompts(chunks).mapInPandas(write, schema), chunks.most_chunks()
    else:
        spark, chunk = df.sparkSession, F.floor(F.col("chars_before") / int(max_chars)).cast("long")
        numbers = Written(_line_numbers(df, same_text=True), "digest-numbers")
        left = (numbers.df.agg(F.max(chunk)).first()[0] or 0) + 1  # one number to the driver
        path = f"{checkpoint_dir(spark)}/digest-parts-{uuid.uuid4().hex}"
        slices = _slices(numbers.df)
        inside = F.array_sort(F.collect_list(F.struct("line_no", "packed")))  # max_chars and one line at most
        for part in range(slices):
            own = numbers.df.where(F.pmod(F.xxhash64("_ln_d", chunk), F.lit(slices)) == part).drop("_ln_d").withColumnRenamed("_ln_id", "id")
            lines = _numbered_lines(_lines_of(rows_of(own), None, *[c for c in own.columns if c != "id"]), True)
            written_ = (lines.select("date", chunk.alias("chunk"), "line_no", _packed("line").alias("packed")).groupBy("date", "chunk")
                        .agg(inside.alias("inside")).select("date", "chunk", F.col("inside.line_no").alias("numbers"), F.col("inside.packed").alias("lines"))
                        .mapInPandas(write, schema))
            with short_shuffles(spark):
                written_.write.mode("append").option("compression", "zstd").parquet(path)
        numbers.drop()
        parts = spark.read.schema(schema).parquet(path)
    while left > 1:
        ordered = F.array_sort(F.collect_list(F.struct("chunk", "summary")))  # at most MERGE_PARTS
        parts = (parts.withColumn("into", F.floor(F.col("chunk") / MERGE_PARTS).cast("long")).groupBy("date", "into")
                 .agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk"))).alias("error"),
                      F.transform(ordered, lambda x: x["summary"]).alias("parts"), F.sum("count").alias("count"))
                 .withColumnRenamed("into", "chunk").mapInPandas(merge, schema))
        left = -(-left // MERGE_PARTS)
    res = parts.select("date", F.coalesce("error", "summary").alias("summary"), "count")
    if dates is not None:
        # from the rows, not from the result: that would call the generator again
        written = df.select(day("created_at").alias("date")).distinct()
        empty = (dates.select(F.col("date").cast("date").alias("date")).distinct()
                 .join(written, "date", "left_anti")
                 .select("date", F.concat(F.lit("No feedback received on "), F.col("date").cast("string"), F.lit(".")).alias("summary"),
                         F.lit(0).cast("long").alias("count")))
        res = res.unionByName(empty)
    return res


# ---- E6: ranked similarity search ------------------------------------------------------
#: Rows of a corpus slice and queries of a block that meet in one task; most cells that the corpus is dealt into.
SLICE_ROWS, QUERY_ROWS, MAX_CELLS = 16_384, 1_024, 4_096
#: What rounding may take from a bound on a cosine.
_SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, 1, n)[:, None]


class Cells:
    """The corpus dealt into cells around pivots, each row to its nearest; a cell's widest angle bounds the cosines in it.

    Pivots are corpus rows drawn by a hash of the id, one for about
    ``SLICE_ROWS`` rows and at most ``MAX_CELLS``, so they and the cells' angles
    may pass through the driver. Zero vectors are a cell of their own (-1).
    ``rows`` is a stored table (id, v, cell, part); a part has about ``SLICE_ROWS`` rows.
    """

    def __init__(self, corpus: DataFrame, slice_rows: int):
        n = corpus.count()  # one number to the driver
        cells = min(MAX_CELLS, max(1, -(-n // slice_rows)))
        drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
        pivots = _unit([r.v for r in drawn]) if drawn else np.zeros((0, 1))
        self.pivots = pivots

        def deal(batches):
            for pdf in batches:
                if len(pdf):
                    u = _unit(pdf["v"])
                    c = u @ pivots.T
                    near = c.argmax(axis=1)
                    empty = ~u.any(axis=1)
                    yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": np.where(empty, -1, near).astype(np.int32),
                                        "near": np.where(empty, 0.0, c[np.arange(len(u)), near])})

        dealt = written(corpus.mapInPandas(deal, "id long, v array<double>, cell int, near double"), "cells")
        sizes = frozen(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")))
        self.cells = [(r.cell, r.least) for r in sizes.collect()]  # at most MAX_CELLS + 1
        parts = sizes.select(F.col("cell").alias("p_cell"), F.ceil(F.col("n") / slice_rows).cast("int").alias("parts"))
        self.rows = dealt.join(F.broadcast(parts), F.col("cell") == F.col("p_cell")).select(
            "id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        self.parts = parts


def cell_bounds(u: np.ndarray, pivots: np.ndarray, cells: list[tuple[int, float]]) -> np.ndarray:
    """Upper bound of the cosine of each unit query with any row of each of ``cells`` (number, least cosine to its pivot)."""
    out = np.zeros((len(u), len(cells)))
    idle = ~u.any(axis=1)
    for j, (cell, least) in enumerate(cells):
        if cell >= 0:
            angle = np.arccos(np.clip(u @ pivots[cell], -1, 1)) - np.arccos(np.clip(least, -1, 1))
            out[:, j] = np.where(idle, 0.0, np.cos(np.clip(angle, 0, np.pi)))
    return out + _SLACK


def _best_of(k: int):
    def best(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(q):
            own = own.sort_values("id")  # equal scores: the smaller id first
            ids, scores = own["id"].to_numpy(), _unit(own["v"]) @ _unit(q["qv"]).T
            for j, qid in enumerate(q["qid"]):
                top = np.argsort(-scores[:, j], kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": qid, "id": ids[top], "score": scores[top, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
    return best


def _visited(cells: Cells, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each part of the cells that ``visits`` (qid, qv, block, cell) names."""
    blocks = visits.groupBy(F.col("cell").alias("b_cell")).agg(F.collect_set("block").alias("blocks"))
    rows = cells.rows.join(blocks, F.col("cell") == F.col("b_cell")).select("id", "v", "cell", "part", F.explode("blocks").alias("block"))
    asked = visits.join(F.broadcast(cells.parts), F.col("cell") == F.col("p_cell")).select(
        "qid", "qv", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"))
    return (rows.groupBy("cell", "part", "block").cogroup(asked.groupBy("q_cell", "q_part", "q_block"))
            .applyInPandas(_best_of(k), "query_id long, id long, score double"))


def cells_to_visit(cells: Cells, asked: DataFrame, first: bool) -> DataFrame:
    """(qid, qv, block, cell) for each query of ``asked`` (qid, qv, block, kth): with ``first`` the cell of highest bound,
    else the others whose bound reaches ``kth``."""
    names, pivots, known = np.array([c for c, _ in cells.cells], dtype=np.int32), cells.pivots, cells.cells

    def pick(batches):
        for pdf in batches:
            if len(pdf) and len(names):
                high = cell_bounds(_unit(pdf["qv"]), pivots, known)
                top = high.argmax(axis=1)
                if first:
                    q, c = np.arange(len(pdf)), top
                else:
                    reach = high >= pdf["kth"].to_numpy()[:, None]
                    reach[np.arange(len(pdf)), top] = False
                    q, c = np.nonzero(reach)
                yield pdf.iloc[q].assign(cell=names[c])[["qid", "qv", "block", "cell"]]

    return asked.mapInPandas(pick, "qid long, qv array<double>, block int, cell int")


def similar_texts(corpus: DataFrame, queries: DataFrame, k: int = 10, vec_col: str = "embedding",
                  id_col: str = "vec_id", query_id_col: str = "query_id", query_vec_col: str = "embedding",
                  slice_rows: int | None = None) -> DataFrame:
    """For each query vector the ``k`` most cosine-similar corpus rows:
    (query_id, rank, id, score).

    Exact, without looking everywhere: the corpus is dealt into cells around
    pivots (``Cells``); a query first visits the cell that promises most, which
    gives it a k-th score, and then only the cells whose bound - the cosine of
    its angle to the pivot less the cell's widest angle - reaches that. A task
    holds one part of a cell and one block of the queries that visit it, of
    bounded size whatever the tables. Rows and queries without a vector take
    no part; query ids are unique.
    """
    kk = int(k)
    vectors = lambda df, i, v, names: df.select(F.col(i).cast("long").alias(names[0]), F.col(v).cast("array<double>").alias(names[1])).where(
        F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
    rows, size = vectors(corpus, id_col, vec_col, ("id", "v")), slice_rows or SLICE_ROWS
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    asked = vectors(queries, query_id_col, query_vec_col, ("qid", "qv")).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())).cast("long")).where(F.col("rank") <= kk)
    if rows.limit(size + 1).count() <= size:  # one part: nothing to leave out
        part = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = part.groupBy("part").cogroup(asked.groupBy("block")).applyInPandas(_best_of(kk), "query_id long, id long, score double")
        return ranked(found).select("query_id", "rank", "id", "score")
    cells = Cells(rows, size)
    found = frozen(_visited(cells, cells_to_visit(cells, asked, True), kk))
    kth = ranked(found).where(F.col("rank") == kk).select(F.col("query_id").alias("k_id"), F.col("score").alias("k_score"))
    left = asked.join(kth, F.col("qid") == F.col("k_id"), "left").withColumn("kth", F.coalesce("k_score", F.lit(-2.0)))
    rest = _visited(cells, cells_to_visit(cells, left.select("qid", "qv", "block", "kth"), False), kk)
    return ranked(found.unionByName(rest)).select("query_id", "rank", "id", "score")


def label_centroids(emb: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per label (query block for ``similar_texts``): elementwise
    average via posexplode + groupBy, bounded by #labels x dimension."""
    e = emb.select(F.col(label_col).alias("query_id"), F.posexplode(vec_col).alias("pos", "x"))
    per = e.groupBy("query_id", "pos").agg(F.avg("x").alias("m"))
    return per.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))
