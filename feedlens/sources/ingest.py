"""Ingest of new feedback (S3, P11) and of change requests.

Request bodies are raw JSON text. They are parsed as VARIANT so the JSON
type of each field stays visible: the reference accepts ``feedback`` only
if it is a JSON *string*, a patch ``sentiment`` only if it is a JSON
*number*. (A schema-driven JSON read would coerce 5 to "5".) Each function
returns one frame with a ``reject_reason`` column; ``accepted``/``rejected``
split it with two filters over the same parsed frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.analysis import allow_repeated_keys, field
from feedlens.functions.scalars import js_trim, parse_int

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return v.isNotNull() & (_kind(v) == "STRING")


def _is_number(v: Column) -> Column:
    k = _kind(v)
    return v.isNotNull() & (k.isin(*_NUMERIC) | k.startswith("DECIMAL"))


def _truthy(v: Column) -> Column:
    """JavaScript truthiness of a JSON value (missing -> false)."""
    k = _kind(v)
    s = F.try_variant_get(v, "$", "string")
    falsy = (v.isNull() | F.is_variant_null(v) | ((k == "STRING") & (s == "")) | ((k == "BOOLEAN") & (s == "false"))
             | ((k.isin(*_NUMERIC) | k.startswith("DECIMAL")) & (F.try_variant_get(v, "$", "double") == 0)))
    return ~F.coalesce(falsy, F.lit(False))


def _text_of(v: Column) -> Column:
    """JavaScript ``String(v)``: an object is ``[object Object]``, an array its
    elements joined by commas (null: nothing)."""
    k = _kind(v)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                        lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.lit("[object Object]"))
                        .otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
    return (F.when(k.startswith("OBJECT"), F.lit("[object Object]")).when(k.startswith("ARRAY"), F.array_join(items, ","))
            .otherwise(F.try_variant_get(v, "$", "string")))


def _or_default(v: Column, default) -> Column:
    return F.when(_truthy(v), _text_of(v)).otherwise(default)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def ingest(raw: DataFrame, body_col: str = "value") -> DataFrame:
    """New-feedback requests -> (text, source, channel, severity_hint,
    user_tier, reject_reason, raw body).

    ``feedback`` must be a non-blank JSON string (JS-trimmed); source,
    channel, tier default when missing or falsy (``tier`` wins over
    ``user_tier``); severity_hint falls back to null.
    """
    allow_repeated_keys(raw.sparkSession)
    out = raw.withColumn("_b", F.try_parse_json(F.col(body_col)))
    body = F.col("_b")
    fb, tier, utier = field(body, "feedback"), field(body, "tier"), field(body, "user_tier")
    text = js_trim(F.try_variant_get(fb, "$", "string"))
    ok = body.isNotNull() & _truthy(body) & _is_string(fb) & (text != "")
    return out.select(
        "*",
        F.when(ok, text).alias("text"),
        F.when(ok, _or_default(field(body, "source"), F.lit(S.DEFAULT_SOURCE))).alias("source"),
        F.when(ok, _or_default(field(body, "channel"), F.lit(S.DEFAULT_CHANNEL))).alias("channel"),
        F.when(ok, _or_default(field(body, "severity_hint"), F.lit(None).cast("string"))).alias("severity_hint"),
        F.when(ok, F.when(_truthy(tier), _text_of(tier)).when(_truthy(utier), _text_of(utier))
               .otherwise(F.lit(S.DEFAULT_TIER))).alias("user_tier"),
        F.when(~ok, F.lit("Missing 'feedback' string in body")).alias("reject_reason"),
    ).drop("_b")


def parse_changes(raw: DataFrame, op_col: str = "op", id_col: str = "id_text", body_col: str = "body",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Change requests -> (op, id, status, sentiment, tag, text, reject_reason).

    ``op`` is ``patch`` or ``delete``; the id is parsed like ``parseInt(id, 10)``
    and must be non-zero. A patch body must be truthy JSON. The effective
    columns follow the reference's statement order, quirks included:
    status if a string; sentiment if a number (not clamped); tag alone if a
    string and text is falsy; trimmed non-blank text alone if tag is falsy;
    both together if text is non-blank and tag is a string (so tag "" with
    text sets both, and a tag with blank text sets nothing).
    """
    allow_repeated_keys(raw.sparkSession)
    op = F.lower(F.col(op_col))
    pid = parse_int(F.col(id_col))
    out = raw.withColumns({"_op": op, "_id": pid, "_b": F.try_parse_json(F.col(body_col))})
    body = F.col("_b")
    st, se, tg, tx = (field(body, k) for k in ("status", "sentiment", "tag", "text"))
    tx_trim = js_trim(F.try_variant_get(tx, "$", "string"))
    text_ok = _is_string(tx) & (tx_trim != "")
    tag_alone = _is_string(tg) & ~_truthy(tx)
    text_alone = text_ok & ~_truthy(tg)
    both = text_ok & _is_string(tg)
    bad_id = F.col("_id").isNull() | (F.col("_id") == 0)
    is_patch = F.col("_op") == "patch"
    reason = (F.when(~F.col("_op").isin("patch", "delete"), F.lit("Unknown operation"))
              .when(bad_id, F.lit("Invalid ID"))
              .when(is_patch & (body.isNull() | ~_truthy(body)), F.lit("Empty body")))
    return out.select(
        *keep, F.col("_op").alias("op"), F.col("_id").alias("id"),
        F.when(is_patch & _is_string(st), F.try_variant_get(st, "$", "string")).alias("status"),
        F.when(is_patch & _is_number(se), F.try_variant_get(se, "$", "double")).alias("sentiment"),
        F.when(is_patch & (tag_alone | both), F.try_variant_get(tg, "$", "string")).alias("tag"),
        F.when(is_patch & (text_alone | both), tx_trim).alias("text"),
        reason.alias("reject_reason"),
    )
