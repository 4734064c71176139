"""Scalar column builders for the feedback model.

All are native Catalyst expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import schema as S

__all__ = [
    "col_of", "day", "hours_between", "trunc_int", "impact", "sentiment_bucket", "sentiment_class",
    "utc_now", "js_trim", "default_if_empty", "bubble_xyr", "fixed", "preview", "capitalize_first",
    "mood5", "mood3", "sentiment_pct", "label_or", "parse_int", "today_utc", "stakeholder_group", "ntz_literal",
    "utc_instant", "utc_wall_clock",
    "JS_WHITESPACE",
]

# Characters removed by the JavaScript String.prototype.trim (WhiteSpace and
# LineTerminator code points), written as a regex class usable by both Java
# and RE2 regex engines.
JS_WHITESPACE = (r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(ts) -> Column:
    """``DATE(ts)``."""
    return F.to_date(col_of(ts))


def hours_between(start, end) -> Column:
    """whole hours from start to end, truncated toward zero.

    Exact integer arithmetic on microseconds instead of fractional Julian days.
    """
    return F.timestamp_diff("HOUR", col_of(start), col_of(end))


def trunc_int(x) -> Column:
    """``CAST(x AS INTEGER)`` truncating toward zero; out of range -> null."""
    return col_of(x).try_cast("int")


def impact(sentiment) -> Column:
    """impact = |sentiment|."""
    return F.abs(col_of(sentiment))


def sentiment_bucket(sentiment) -> Column:
    """rollup bucket, thresholds +-0.25 inclusive."""
    s = col_of(sentiment)
    return (F.when(s >= 0.25, F.lit("positive"))
            .when(s <= -0.25, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def sentiment_class(sentiment) -> Column:
    """P5: library filter class, +-0.3 exclusive, null counts as 0 (neutral)."""
    s = F.coalesce(col_of(sentiment), F.lit(0.0))
    return (F.when(s > 0.3, F.lit("positive"))
            .when(s < -0.3, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def utc_now() -> Column:
    """``datetime('now')`` - UTC wall clock at second precision, whatever
    the session time zone."""
    utc = F.convert_timezone(None, F.lit("UTC"), F.current_timestamp())
    return F.date_trunc("second", utc).cast("timestamp_ntz")


def utc_instant(ts) -> Column:
    """Naive UTC wall clock (TIMESTAMP_NTZ) -> the instant (TIMESTAMP), whatever
    the session time zone (needed by watermarks and time windows)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col_of(ts)).cast("timestamp")


def utc_wall_clock(ts) -> Column:
    """Instant (TIMESTAMP) -> naive UTC wall clock (TIMESTAMP_NTZ)."""
    return F.convert_timezone(None, F.lit("UTC"), col_of(ts))


def ntz_literal(value) -> Column:
    """A naive Python datetime as a TIMESTAMP_NTZ literal, independent of the
    Python and session time zones."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# The same characters as literals, for the cheap first/last character test.
JS_WHITESPACE_CHARS = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\u00a0", "\u1680"] + \
    [chr(c) for c in range(0x2000, 0x200B)] + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]


def js_trim(s) -> Column:
    """JavaScript ``trim()`` (all Unicode white space, not only spaces).

    The regex only runs when the first or last character is white space; most
    texts skip it."""
    c = col_of(s)
    edge = F.substring(c, 1, 1).isin(*JS_WHITESPACE_CHARS) | F.substring(c, -1, 1).isin(*JS_WHITESPACE_CHARS)
    return F.when(edge, F.regexp_replace(c, rf"^{JS_WHITESPACE}+|{JS_WHITESPACE}+$", "")).otherwise(c)


def default_if_empty(c, *alternatives) -> Column:
    """JavaScript ``a || b || 'x'``: null and empty string take the next value.

    Column alternatives are tested the same way; a plain Python value is the
    final literal default.
    """
    cols = [F.nullif(col_of(c), F.lit(""))]
    for a in alternatives:
        cols.append(F.nullif(a, F.lit("")) if isinstance(a, Column) else F.lit(a))
    return F.coalesce(*cols)


def bubble_xyr(urgency, impact_col) -> Column:
    """bubble chart point: x = urgency*100, y = impact*100 (null -> 0),
    r = sqrt(impact, or 1 when null/0) * 8."""
    u, i = col_of(urgency), col_of(impact_col)
    return F.struct(
        (F.coalesce(u, F.lit(0.0)) * 100).alias("x"),
        (F.coalesce(i, F.lit(0.0)) * 100).alias("y"),
        (F.sqrt(F.when(F.coalesce(i, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(i)) * 8).alias("r"),
    )


def fixed(x, digits: int = 2, null_text: str = "N/A") -> Column:
    """JavaScript ``toFixed(digits)``; null -> ``N/A``.

    toFixed rounds the exact binary value, so 1.005 (really 1.00499...) gives
    1.00. The value is scaled by a power of two to a whole number, which is
    exact, and rounded in decimal arithmetic. From 2**20 on, where no digit is
    left to decide it, the usual formatting applies.
    """
    c = col_of(x).cast("double")
    p = 10 ** int(digits)
    size = F.abs(c)
    shift = F.when(size < 4, F.lit(2.0 ** 60)).when(size < 2 ** 10, F.lit(2.0 ** 52)).otherwise(F.lit(2.0 ** 42))
    small = F.when(size < 2 ** 20, size).otherwise(F.lit(0.0))
    whole = (small * shift).cast("long").cast("decimal(20,0)")
    unit = shift.cast("long").cast("decimal(20,0)")
    halves, two = whole * F.lit(2 * p).cast("decimal(10,0)") + unit, unit * F.lit(2).cast("decimal(1,0)")
    n = ((halves - halves % two) / two).cast("long")  # whole-number division: a quotient would be rounded first
    text = F.floor(n / F.lit(p)).cast("long").cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % p).cast("string"), int(digits), "0"))
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)
    return (F.when(c.isNull(), F.lit(null_text)).when(size < 2 ** 20, text)
            .otherwise(F.format_string(f"%.{int(digits)}f", c)))


def to_minute(ts) -> Column:
    """F16: a timestamp as shown in the library view, cut to the minute (``yyyy-MM-dd HH:mm``)."""
    return F.date_format(col_of(ts), "yyyy-MM-dd HH:mm")


def preview(s, n: int) -> Column:
    """F16: first ``n`` characters."""
    return F.substring(col_of(s), 1, int(n))


def capitalize_first(s) -> Column:
    """upper-case the first character only (unlike initcap)."""
    c = col_of(s)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def mood5(sentiment) -> Column:
    """five-level mood of the sentiment slider."""
    v = col_of(sentiment)
    return (F.when(v <= -0.6, F.lit("very_negative"))
            .when(v < -0.2, F.lit("negative"))
            .when(v > 0.6, F.lit("very_positive"))
            .when(v > 0.2, F.lit("positive"))
            .otherwise(F.lit("neutral")))


def mood3(sentiment) -> Column:
    """three colour bands; null -> unknown."""
    v = col_of(sentiment)
    return (F.when(v.isNull(), F.lit("unknown"))
            .when(v < -0.2, F.lit("negative"))
            .when(v <= 0.2, F.lit("neutral"))
            .otherwise(F.lit("positive")))


def sentiment_pct(v) -> Column:
    """slider position ``Math.round((v+1)/2*100)`` (JS rounds half up)."""
    return F.floor((col_of(v) + 1) / 2 * 100 + 0.5)


def label_or(c, default: str) -> Column:
    """display label, null or empty -> default."""
    return F.coalesce(F.nullif(col_of(c), F.lit("")), F.lit(default))


def parse_int(s) -> Column:
    """JavaScript ``parseInt(s, 10)``: leading digits after optional white
    space and sign; no digits -> null (NaN)."""
    digits = F.regexp_extract(col_of(s).cast("string"), rf"^{JS_WHITESPACE}*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def today_utc() -> Column:
    """today's date in UTC."""
    return F.to_date(utc_now())


def stakeholder_group(tier) -> Column:
    """External (paying customer tiers) vs Internal (staff roles)."""
    t = col_of(tier)
    return (F.when(t.isin(*S.EXTERNAL_TIERS), F.lit("External"))
            .when(t.isin(*S.INTERNAL_TIERS), F.lit("Internal"))
            .otherwise(F.lit("Unknown")))
