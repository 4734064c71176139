"""Library view: filters, sort, paging, text search and top-k lists
(P2-P10, K1-K7, J2, J3).

Top-k operators end in ``orderBy(...).limit(k)``, which Catalyst plans as
TakeOrderedAndProject: each task keeps its own k best rows and only
#tasks*k rows meet at the end - no global sort. Every order has an ``id``
tie-break so results are deterministic.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.scalars import bubble_xyr, day, fixed, impact, label_or, mood5, sentiment_class, sentiment_pct, to_minute
from feedlens.plans.ranking import prefix_sum_within
from feedlens.session import frozen
from feedlens.sources.feedback import PARTITION_COLUMN

# Columns of the library view, search and urgency lists, in order. Fixed values.
LIBRARY_COLUMNS = ["id", "text", "source", "channel", "tag", "sentiment", "urgency_score", "summary", "status",
                   "user_tier", "created_at", "analyzed_at", "updated_at"]
SEARCH_COLUMNS = ["id", "text", "tag", "sentiment", "status", "user_tier", "channel", "created_at"]
URGENCY_COLUMNS = ["id", "tag", "urgency_score", "impact", "status", "created_at"]
UI_COLUMNS = {"id": "id", "status": "status", "tag": "tag", "sentiment": "sentiment", "text": "text",
              "tier": "user_tier", "channel": "channel"}
_JS_WS = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_JS_TRIM = re.compile(f"^{_JS_WS}+|{_JS_WS}+$")


# ---- P3-P5: filters -----------------------------------------------------------
def filter_feedback(df: DataFrame, id: int | None = None, status: str | None = None, tier: str | None = None,
                    channel: str | None = None, tag: str | None = None, sentiment_class_: str | None = None) -> DataFrame:
    """Conjunctive equality filters of the library view; empty/None = no filter.

    ``channel`` is what the UI labels "source". ``sentiment_class_`` is the
    +-0.3 exclusive class with null sentiment counted as 0 (neutral).
    """
    conds = []
    if id:
        conds.append(F.col("id") == int(id))
    for col, val in (("status", status), ("user_tier", tier), ("channel", channel), ("tag", tag)):
        if val:
            conds.append(F.col(col) == val)
    if sentiment_class_:
        conds.append(sentiment_class("sentiment") == sentiment_class_)
    out = df
    for c in conds:
        out = out.where(c)
    return out


# ---- K6: user sort ------------------------------------------------------------
def sort_columns(sort_key: str = "updated_desc", reverse: bool = False) -> list[Column]:
    """Sort expressions for the UI sort keys, each ending with an ``id`` tie-break.

    ``updated_*`` / ``created_*`` sort by that time (updated falls back to
    created); ``positive_desc`` / ``negative_desc`` by sentiment with null as
    0; any other key sorts like the reference falls into: created_at, newest first.
    ``reverse`` gives the same order from the other end.
    """
    key = sort_key or ""
    ident = F.col("id")
    if key in ("positive_desc", "negative_desc"):
        keys = [(F.coalesce(F.col("sentiment"), F.lit(0.0)), key == "negative_desc"), (ident, False)]
    else:
        field, _, direction = key.partition("_")
        t = F.coalesce(F.col("updated_at"), F.col("created_at")) if field == "updated" else F.col("created_at")
        up = direction == "asc" and field in ("updated", "created")
        keys = [(t, up), (ident, up)]
    # nulls are smallest
    return [c.asc_nulls_first() if up != reverse else c.desc_nulls_last() for c, up in keys]


def sort_feedback(df: DataFrame, sort_key: str = "updated_desc") -> DataFrame:
    return df.orderBy(*sort_columns(sort_key))


# ---- K7: paging -----------------------------------------------------------------
_PAGE_KEYS = ["id", "sentiment", "created_at", "updated_at"]


def _page_bounds(df: DataFrame, size: int, page_no: int, clamp: bool) -> tuple[int, int | None]:
    """Offset of a 1-based page and, with ``clamp``, the row count (one number
    to the driver); then a page past the end is the last page."""
    page_no = max(1, int(page_no))
    if not clamp:
        return (page_no - 1) * size, None
    n = df.select("id").count()
    return (min(page_no, max(-(-n // size), 1)) - 1) * size, n


def page(df: DataFrame, sort_key: str = "updated_desc", size: int = 10, page_no: int = 1, clamp: bool = True) -> DataFrame:
    """1-based page of the sorted frame; a page past the end shows the last page.

    An offset top-k (TakeOrderedAndProject) over the id and the sort keys
    alone, counted from the nearer end: in the second half of the table the
    order is reversed, the rows behind the page are the offset, and the page
    is turned round again. So the last page costs what the first does, and
    every task keeps at most min(offset, rest) + size narrow rows. The rows of
    the chosen ids are fetched afterwards (``fetch``), so texts are neither
    sorted nor counted. ``id`` must be unique. For pages far from both ends use
    ``deep_page`` or ``keyset_page``.
    """
    size = int(size)
    keys = df.select(*_PAGE_KEYS)
    start, n = _page_bounds(df, size, page_no, clamp)
    behind = None if n is None else n - min(start + size, n)
    if behind is None or start <= behind:
        return keys.orderBy(*sort_columns(sort_key)).offset(start).limit(size).select("id")
    found = keys.orderBy(*sort_columns(sort_key, reverse=True)).offset(behind).limit(n - behind - start)
    return found.orderBy(*sort_columns(sort_key)).select("id")


def deep_page(df: DataFrame, sort_key: str = "updated_desc", size: int = 10, page_no: int = 1, clamp: bool = True) -> DataFrame:
    """Like ``page``, any depth: rows are numbered by the distributed prefix
    count on the id and the sort keys, so no task holds more than its slice."""
    size = int(size)
    start, _ = _page_bounds(df, size, page_no, clamp)
    numbered = prefix_sum_within(df.select(*_PAGE_KEYS), [], sort_columns(sort_key), None, "_pos")
    return numbered.where((F.col("_pos") >= start) & (F.col("_pos") < start + size)).orderBy("_pos").select("id")


def fetch(rows: DataFrame, ids: DataFrame, sort_key: str = "updated_desc") -> DataFrame:
    """The rows of a page's ids, in the page's order."""
    return sort_feedback(rows.join(ids.select("id"), "id", "left_semi"), sort_key)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """Number of pages, at least 1."""
    return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(int(size))), F.lit(1)).cast("long").alias("pages"))


def keyset_page(df: DataFrame, size: int, after_created_at=None, after_id: int | None = None) -> DataFrame:
    """Deep paging for created_at-desc order: rows strictly after the last seen
    (created_at, id); a pushed-down filter plus a top-k, no offset scan."""
    out = df
    if after_created_at is not None and after_id is not None:
        t = F.lit(after_created_at).cast("timestamp_ntz")
        out = out.where((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("id") < int(after_id))))
    return out.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(int(size))


# ---- P2: visible columns ------------------------------------------------------
def project_columns(df: DataFrame, order: list[str] | None = None, visible: dict | None = None,
                    sort_key: str = "updated_desc") -> DataFrame:
    """User-chosen visible columns in the user's order, as the view shows them.

    ``when`` shows the sort field: updated (falls back to created) or created,
    cut to the minute, or the sentiment for the sentiment sorts. Sentiments
    are two-decimal text (null: ``N/A``), a missing tier is ``unknown`` and a
    missing channel ``-``. ``actions`` is UI only."""
    order = order or ["id", "status", "tag", "sentiment", "text", "tier", "channel", "when", "actions"]
    visible = visible or {c: True for c in order}
    field = (sort_key or "").split("_")[0]
    if field == "created":
        when = to_minute("created_at")
    elif field in ("positive", "negative"):
        when = fixed("sentiment", 2)
    else:
        when = to_minute(F.coalesce("updated_at", "created_at"))
    shown = {c: F.col(name) for c, name in UI_COLUMNS.items()}
    shown |= {"when": when, "sentiment": fixed("sentiment", 2), "tier": label_or("user_tier", "unknown"), "channel": label_or("channel", "-")}
    cols = []
    for c in order:
        if not visible.get(c, False) or c == "actions":
            continue
        cols.append(shown[c].alias(c))
    return df.select(*cols)


# ---- K1, K2, K4: fixed top-k lists -------------------------------------------------
def latest_feedback(df: DataFrame, limit: int = S.LIBRARY_LIMIT) -> DataFrame:
    """K1: newest rows by last update (13 columns)."""
    return (df.select(*LIBRARY_COLUMNS)
            .orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(int(limit)))


def latest_analyzed(df: DataFrame, limit: int = S.LATEST_ANALYZED_LIMIT) -> DataFrame:
    """K2: latest analysed rows (text, tag, sentiment; id kept as tie-break)."""
    return (df.where(F.col("analyzed_at").isNotNull())
            .select("id", "text", "tag", "sentiment", "analyzed_at")
            .orderBy(F.col("analyzed_at").desc(), F.col("id").desc()).limit(int(limit))
            .drop("analyzed_at"))


def urgency_impact(df: DataFrame, limit: int = S.URGENCY_LIMIT) -> DataFrame:
    """K4: most urgent rows with impact = |sentiment|."""
    return (df.where(F.col("urgency_score").isNotNull())
            .select("id", "tag", "urgency_score", impact("sentiment").alias("impact"), "status", "created_at")
            .orderBy(F.col("urgency_score").desc(), F.col("id").desc()).limit(int(limit)))


def urgency_bubbles(df: DataFrame, limit: int = S.URGENCY_LIMIT) -> DataFrame:
    """K4 + F14: the priority-matrix points of the urgency chart: per urgent
    row (top ``limit``) x = urgency*100, y = impact*100, r = sqrt(impact or 1)*8."""
    pts = urgency_impact(df, limit)
    return pts.select("id", bubble_xyr("urgency_score", "impact").alias("b")).select("id", "b.x", "b.y", "b.r")


def sentiment_slider(df: DataFrame) -> DataFrame:
    """what the sentiment editor shows per row with a sentiment:
    the slider position in percent, the five-level mood and the signed
    two-decimal value (``+0.40`` / ``-0.25``)."""
    v = F.col("sentiment")
    text = F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("")), fixed(v, 2))
    return df.where(v.isNotNull()).select("id", sentiment_pct(v).cast("long").alias("pct"),
                                          mood5(v).alias("mood"), text.alias("value_text"))


# ---- P8: one day ------------------------------------------------------------------
def feedback_by_date(df: DataFrame, date: str) -> DataFrame:
    """Rows created on ``date``, newest first. ``DATE(created_at) = d``
    becomes a pushed timestamp range; a ``created_date`` partition column,
    when present, is filtered too so whole folders are pruned."""
    out = df
    if PARTITION_COLUMN in df.columns:
        out = out.where(F.col(PARTITION_COLUMN) == F.lit(date).cast("date"))
    return (out.where(day("created_at") == F.lit(date).cast("date")).select(*SEARCH_COLUMNS)
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


# ---- P9/K3: substring search --------------------------------------------------------
def like_pattern(q: str, literal: bool = False) -> str:
    """``%q%`` for Spark LIKE: backslashes doubled so they match themselves
    (the reference has no escape character); ``%``/``_`` stay wildcards unless
    ``literal``."""
    p = q.replace("\\", "\\\\")
    if literal:
        p = p.replace("%", "\\%").replace("_", "\\_")
    return f"%{p}%"


def like_regex(q: str, literal: bool = False) -> str:
    """The substring LIKE ``%q%`` as a Java regex for ``rlike`` (a find):
    ``%`` -> ``.*``, ``_`` -> one character, every other ASCII symbol
    escaped. ``(?i)`` without ``(?u)`` folds case for ASCII letters only -
    exactly the reference's LIKE - and ``(?s)`` lets wildcards cross newlines."""
    out = []
    for ch in q:
        if ch == "%" and not literal:
            out.append(".*")
        elif ch == "_" and not literal:
            out.append(".")
        elif ch.isascii() and not ch.isalnum():
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "(?s)(?i)" + "".join(out)


def search_text(df: DataFrame, q: str, limit: int = S.SEARCH_LIMIT, fold: str = "ascii",
                literal: bool = False) -> DataFrame:
    """Substring search over the whole text, newest created first, top ``limit``.

    ``q`` is JS-trimmed; an empty query returns no rows. Case folding is
    ASCII-only by default (``fold='unicode'`` lower-cases both sides with
    ``lower``). The match is one regex scan per text, no folded copy of the
    text is built. A leading wildcard cannot use Parquet statistics, so this
    is a column-pruned scan plus a per-task top-k; no shuffle.
    """
    q = _JS_TRIM.sub("", q or "")
    if not q:
        return df.select(*SEARCH_COLUMNS).where(F.lit(False))
    if fold == "ascii":
        cond = F.col("text").rlike(like_regex(q, literal))
    else:
        cond = F.lower(F.col("text")).like(like_pattern(q.lower(), literal))
    return (df.where(cond).select(*SEARCH_COLUMNS)
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(int(limit)))


# ---- J2, J3: lookups -------------------------------------------------------------
_DRILL_KEYS = ("status", "tag", "user_tier")


def drill_down(df: DataFrame, point_id: int) -> DataFrame:
    """Ids of the rows that share the status, tag and tier of one point; a
    missing value of the point means "no filter on that column". Three equality
    conditions against the point's row (a scalar lookup), no join."""
    point = df.where(F.col("id") == int(point_id))
    conds = F.lit(True)
    for c in _DRILL_KEYS:
        v = point.select(F.max(F.nullif(F.col(c), F.lit("")))).scalar()
        conds = conds & (v.isNull() | (F.col(c) == v))
    return df.where(conds).select("id")


class SimilarItems:
    """J2 for many points, factorised: which rows share a point's status, tag and tier depends on these three alone.

    Points and rows fall into classes by the three values; a missing value of a
    point is no filter. What is stored is membership and the links between
    classes, so it grows with points plus rows (classes are bounded by the
    vocabularies); pairs are made only where ``pairs`` is asked for them.

    - ``points``: (point_id, point_class, similar), the number of rows similar to each point;
    - ``rows``: (id, row_class);
    - ``links``: (point_class, row_class, rows).

    A class is named by its values as JSON, missing ones left out. Classes are
    linked by one equi-join per set of columns that occurs as a filter (at
    most 8); the class without a filter is linked to all.
    """

    def __init__(self, df: DataFrame, points: DataFrame):
        keys = df.select("id", *_DRILL_KEYS)
        self.rows = keys.select("id", F.to_json(F.struct(*_DRILL_KEYS)).alias("row_class"))
        asked = points.select(F.col("id").alias("point_id")).join(keys, F.col("point_id") == F.col("id")).select(
            "point_id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in _DRILL_KEYS])
        members = asked.select("point_id", F.to_json(F.struct(*_DRILL_KEYS)).alias("point_class"))
        row_classes = frozen(keys.groupBy(*_DRILL_KEYS).agg(F.count(F.lit(1)).alias("rows")).withColumn("row_class", F.to_json(F.struct(*_DRILL_KEYS))))
        filters = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in _DRILL_KEYS])
        wanted = frozen(asked.select(*_DRILL_KEYS).distinct().select(
            *[F.col(c).alias(f"k_{c}") for c in _DRILL_KEYS], F.to_json(F.struct(*_DRILL_KEYS)).alias("point_class"), filters.alias("kind")))
        parts = []
        for kind in sorted(r[0] for r in wanted.select("kind").distinct().collect()):
            used = [c for c, on in zip(_DRILL_KEYS, kind) if on == "1"]
            if used:
                same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"k_{c}") for c in used])
                parts.append(row_classes.join(wanted.where(F.col("kind") == kind), same).select("point_class", "row_class", "rows"))
            else:  # one class
                parts.append(row_classes.select(F.lit("{}").alias("point_class"), "row_class", "rows"))
        none = row_classes.select(F.lit("").alias("point_class"), "row_class", "rows").where(F.lit(False))
        self.links = reduce(DataFrame.unionByName, parts, none)
        totals = self.links.groupBy(F.col("point_class").alias("t_class")).agg(F.sum("rows").alias("similar"))
        self.points = members.join(totals, F.col("point_class") == F.col("t_class")).select("point_id", "point_class", "similar")

    def pairs(self, points: DataFrame | None = None) -> DataFrame:
        """(point_id, id) of the rows similar to each point, of ``points`` (a frame with ``point_id``) alone if given."""
        own = self.points if points is None else self.points.join(points.select("point_id"), "point_id", "left_semi")
        met = own.select("point_id", "point_class").join(self.links.select("point_class", "row_class"), "point_class")
        return met.join(self.rows, "row_class").select("point_id", "id")


def similar_items(df: DataFrame, points: DataFrame) -> DataFrame:
    """J2 for several points at once: (point_id, id) of the rows sharing each
    point's (status, tag, tier), a missing value being no filter. All pairs;
    ``SimilarItems`` has them factorised."""
    return SimilarItems(df, points).pairs()


def lookup(df: DataFrame, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Library rows for a set of ids (e.g. search hits): a semi-join on id."""
    out = df.join(ids.select("id").distinct(), "id", "left_semi")
    return out.select(*(columns or LIBRARY_COLUMNS))
