"""Model-response normalisation (F7-F11, E2) and the rule-based scorer.

The model's raw answer is text that is *meant* to be JSON. It is parsed as
VARIANT so JSON types stay visible (a JSON string "0.4" is not the number
0.4), then every field is coerced with JavaScript ``Number()`` rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.scalars import col_of, js_trim

__all__ = ["allow_repeated_keys", "normalize_tag", "js_number", "clamp_number", "parse_response", "field",
           "urgency_field", "cut_summary", "normalize_analysis", "keyword_scores"]

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalize_tag(raw) -> Column:
    """lower-cased substring cascade over the tag text, first hit wins.

    Substring traps are kept on purpose ("debug" -> Bug Report, "author" ->
    Security). Null or empty input -> Other.
    """
    t = F.lower(F.coalesce(col_of(raw).cast("string"), F.lit("")))
    expr = None
    for tag, words in S.TAG_KEYWORDS:
        cond = None
        for w in words:
            c = t.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    return expr.otherwise(F.lit("Other"))


def _variant_tag_text(v: Column) -> Column:
    """JavaScript ``(input || "").toString()`` for a VARIANT field."""
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
            .when(kind == "STRING", as_text)
            .when(kind == "BOOLEAN", F.when(as_text == "true", F.lit("true")).otherwise(F.lit("")))
            .when(kind.startswith("ARRAY"), F.to_json(v))
            .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
            .otherwise(as_text))


def _number_parts(v: Column) -> dict[str, Column]:
    """Per-field pieces js_number needs, to be materialised once as columns."""
    return {
        "missing": v.isNull(),
        "jnull": F.is_variant_null(v),
        "kind": F.schema_of_variant(v),
        "str": F.when(F.schema_of_variant(v) == "STRING", js_trim(F.try_variant_get(v, "$", "string"))),
        "dbl": F.try_variant_get(v, "$", "double"),
        "bool": F.try_variant_get(v, "$", "boolean"),
    }


def _number_from_parts(missing: Column, jnull: Column, kind: Column, s: Column,
                       dbl: Column, boolean: Column) -> Column:
    ls = F.lower(s)
    nan = F.lit(float("nan"))
    from_string = (F.when(s == "", F.lit(0.0))
                   .when(s.rlike(_DECIMAL), s.try_cast("double"))
                   .when(ls.rlike(r"^0x[0-9a-f]+$"), F.conv(F.substring(s, 3, 1 << 30), 16, 10).try_cast("double"))
                   .when(ls.rlike(r"^0o[0-7]+$"), F.conv(F.substring(s, 3, 1 << 30), 8, 10).try_cast("double"))
                   .when(ls.rlike(r"^0b[01]+$"), F.conv(F.substring(s, 3, 1 << 30), 2, 10).try_cast("double"))
                   .when(s.rlike(r"^[+]?Infinity$"), F.lit(float("inf")))
                   .when(s == "-Infinity", F.lit(float("-inf")))
                   .otherwise(nan))
    return (F.when(missing, nan)
            .when(jnull, F.lit(0.0))
            .when(kind == "BOOLEAN", F.when(boolean, F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(kind == "STRING", F.coalesce(from_string, nan))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), dbl)
            .otherwise(nan))


def js_number(v: Column) -> Column:
    """JavaScript ``Number(v)`` for a VARIANT field; NaN for anything that is
    not a number (missing key included); JSON null -> 0, booleans -> 0/1.
    String rules: trimmed; "" -> 0; decimal literals; 0x/0o/0b prefixes;
    "Infinity" with optional sign. For wide projections prefer
    ``normalize_analysis``, which materialises the pieces once."""
    p = _number_parts(v)
    return _number_from_parts(p["missing"], p["jnull"], p["kind"], p["str"], p["dbl"], p["bool"])


def _clamp(n: Column, lo: float, hi: float, fallback: float) -> Column:
    finite = ~F.isnan(n) & (n != float("inf")) & (n != float("-inf"))
    return F.when(finite, F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), n))).otherwise(F.lit(float(fallback)))


def clamp_number(v: Column, lo: float, hi: float, fallback: float) -> Column:
    """F8: ``Number(v)`` clamped to [lo, hi]; non-finite -> fallback."""
    return _clamp(js_number(v), lo, hi, fallback)


def allow_repeated_keys(spark) -> None:
    """JSON objects may repeat a key; the last one counts, as in JavaScript."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_response(raw) -> Column:
    """tolerant JSON parse of the model output; bad JSON -> SQL null."""
    return F.try_parse_json(col_of(raw))


def field(parsed: Column, name: str) -> Column:
    """``parsed?.name`` as VARIANT: SQL null = missing, variant null = JSON null."""
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def urgency_field(parsed: Column) -> Column:
    """``parsed?.urgency ?? parsed?.urgency_score`` (null and missing both fall through)."""
    u = field(parsed, "urgency")
    return F.when(u.isNull() | F.is_variant_null(u), field(parsed, "urgency_score")).otherwise(u)


def cut_summary(v: Column) -> Column:
    """a JSON string cut to the first SUMMARY_MAX characters, anything else -> ""."""
    txt = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.substring(txt, 1, S.SUMMARY_MAX), F.lit(""))


def normalize_analysis(df: DataFrame, raw_col: str = "raw_response", prefix: str = "") -> DataFrame:
    """Model text -> (tag, sentiment, urgency_score, summary).

    A null raw response means the model call failed: the row stays pending
    (all four outputs null). Everything else, even unparsable text, gets the
    reference's fallbacks (Other, 0, 0.2, "").

    Work is staged in helper columns (parse once, extract each field once) so
    the generated code stays small enough for whole-stage codegen.
    """
    lo_s, hi_s, fb_s = S.SENTIMENT_RANGE
    lo_u, hi_u, fb_u = S.URGENCY_RANGE
    allow_repeated_keys(df.sparkSession)
    out = df.withColumn("_fl_p", parse_response(raw_col))
    p = F.col("_fl_p")
    out = out.withColumns({"_fl_vt": field(p, "tag"), "_fl_vs": field(p, "sentiment"),
                           "_fl_vu": urgency_field(p), "_fl_vm": field(p, "summary")})
    parts = {}
    for key, vcol in (("s", "_fl_vs"), ("u", "_fl_vu")):
        for name, c in _number_parts(F.col(vcol)).items():
            parts[f"_fl_{key}_{name}"] = c
    parts["_fl_tt"] = _variant_tag_text(F.col("_fl_vt"))
    parts["_fl_sm"] = cut_summary(F.col("_fl_vm"))
    out = out.withColumns(parts)

    def num(key):
        c = lambda n: F.col(f"_fl_{key}_{n}")
        return _number_from_parts(c("missing"), c("jnull"), c("kind"), c("str"), c("dbl"), c("bool"))

    # the numbers get their own stage: the clamp reads each one four times
    out = out.withColumns({"_fl_s_num": num("s"), "_fl_u_num": num("u")})
    ok = F.col(raw_col).isNotNull()
    out = out.withColumns({
        f"{prefix}tag": F.when(ok, normalize_tag(F.col("_fl_tt"))),
        f"{prefix}sentiment": F.when(ok, _clamp(F.col("_fl_s_num"), lo_s, hi_s, fb_s)),
        f"{prefix}urgency_score": F.when(ok, _clamp(F.col("_fl_u_num"), lo_u, hi_u, fb_u)),
        f"{prefix}summary": F.when(ok, F.col("_fl_sm")),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_fl_")])


def keyword_scores(text) -> dict[str, Column]:
    """Rule-based stand-in for the model: tag from the keyword cascade on the
    text itself, sentiment and urgency at the reference's fallbacks."""
    return {
        "tag": normalize_tag(col_of(text)),
        "sentiment": F.lit(S.SENTIMENT_RANGE[2]),
        "urgency_score": F.lit(S.URGENCY_RANGE[2]),
        "summary": F.lit(""),
    }
