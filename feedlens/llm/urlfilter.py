"""URL filter rules looked up by expression digests.

Each URL is expanded into host-suffix x path-prefix expressions (the host and
its parent domains; the path cut at the lengths that rule paths have). An
expression is looked up by the first ``PREFIX_HEX`` digits of its SHA-256 in
an equi-join with the rules: the rows that are exchanged carry that prefix and
the two numbers that say which expression it is. For the few that meet a rule
the full digest is worked out and compared, and the longest confirmed rule
decides.

Distinct (host, path) pairs are expanded once, so a URL or host that fills a
third of the table costs one lookup per distinct path. Nothing is collected
but the distinct lengths of the rule paths; they are looked up
``LENGTHS_AT_ONCE`` at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen, put_back, set_aside

LENGTHS_AT_ONCE = 4096
PREFIX_HEX = 8
#: Helper columns begin so.
_HELPERS = ("_u_", "_f_", "_best")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # a line feed separates them: the pair (host, path) is hashed, not their run-on text
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def with_digests(rules: DataFrame) -> DataFrame:
    """The rules (_r_host, _r_path, _r_verdict) with their digests and prefixes; those with a null take no part."""
    rules = rules.select(F.col("host").alias("_r_host"), F.col("path").alias("_r_path"), F.col("verdict").alias("_r_verdict")).dropna().dropDuplicates()
    digest = _digest(F.col("_r_host"), F.col("_r_path"))
    return rules.withColumn("_r_digest", digest).withColumn("_r_key", F.substring("_r_digest", 1, PREFIX_HEX))


def candidates(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The expressions of ``pairs`` (_u_host, _u_path) that fit a rule of ``with_digests``: met by prefix, confirmed by digest."""
    lengths = [r[0] for r in rules.select(F.length("_r_path").alias("n")).distinct().orderBy("n").collect()]
    labels = F.split("_u_host", r"\.")
    suffix = F.array_join(F.slice(labels, F.col("_s"), F.size(labels)), ".")
    digest = _digest(suffix, F.expr("substring(_u_path, 1, _n)"))

    def met(own: list[int]) -> DataFrame:
        fits = F.filter(F.array(*[F.lit(n) for n in own]).cast("array<int>"), lambda n: n <= F.length("_u_path"))
        asked = (pairs.withColumn("_s", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("_n", F.explode(fits))
                 .select("_u_host", "_u_path", "_s", "_n", F.substring(digest, 1, PREFIX_HEX).alias("_key")))
        # startswith, as an equality would be taken into the join's keys, and the digest be worked out and sent for all
        return asked.join(rules, F.col("_key") == F.col("_r_key")).filter(F.col("_r_digest").startswith(digest))

    return reduce(DataFrame.unionByName, [met(lengths[i:i + LENGTHS_AT_ONCE]) for i in range(0, max(1, len(lengths)), LENGTHS_AT_ONCE)])


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
               out: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``urls`` with host, path, deciding rule (host || path; null if none) and verdict added.

    ``rules`` has string columns host, path, verdict. A rule fits its host and
    all its subdomains if the URL's path starts with the rule's path. The
    longest rule (characters of host and path) wins; among rules of the same
    length the one with the longer host, then ``block`` before ``allow``, so
    repeated or conflicting rules have one defined outcome. Rules with a null
    host, path or verdict take no part. URLs that are null or have no ``://``
    have an empty host and path; an empty path fits no rule path that begins
    with ``/``. An empty table gives an empty result, no rules give
    ``default`` for every URL. Columns of ``urls`` that have the names in
    ``out`` are replaced, all others stay.
    """
    urls, away = set_aside(urls, _HELPERS)
    url_col = away.get(url_col, url_col)
    host, path, rule, verdict = (away.get(c, c) for c in out)
    rows = urls.withColumns({"_u_host": url_host(F.col(url_col)), "_u_path": url_path(F.col(url_col))})
    found = (candidates(rows.select("_u_host", "_u_path").distinct(), with_digests(rules))
             .groupBy("_u_host", "_u_path")
             .agg(F.max(F.struct((F.length("_r_host") + F.length("_r_path")).alias("n"),
                                 F.length("_r_host").alias("h"),
                                 (F.col("_r_verdict") == "block").cast("int").alias("b"),
                                 F.concat("_r_host", "_r_path").alias("rule"),
                                 F.col("_r_verdict").alias("verdict"))).alias("_best"))
             .withColumnsRenamed({"_u_host": "_f_host", "_u_path": "_f_path"}))
    found = frozen(found)  # so that the join reads plain exchanges, which Spark splits at a hot URL
    res = (rows.join(found, (F.col("_u_host") == F.col("_f_host")) & (F.col("_u_path") == F.col("_f_path")), "left")
           .withColumns({host: F.col("_u_host"), path: F.col("_u_path"), rule: F.col("_best.rule"),
                         verdict: F.coalesce("_best.verdict", F.lit(default))})
           .drop("_u_host", "_u_path", "_f_host", "_f_path", "_best"))
    return put_back(res, away)
