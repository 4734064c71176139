"""Registered queries of this subpackage and their DuckDB oracles.

Each query applies its operator, with production parameters, to its whole
table and derives the columns of its contract.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import centroids, decontam, html_tree, kdtree, langid, lexical, mixing, sharding, simhash, substring, tokenfiles, toxicity, urlfilter
from feedlens.llm.common import held_out, read_table
from feedlens.session import checkpoint_dir

#: (host, path, verdict); fixed values of the contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
#: The same with a limit that splits small tables, too.
SMALL_SHARD_BYTES = 64 << 10
#: Weights of the sources in code-point order, repeating, and the most a source repeats.
MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = (1, 2, 3), 3, 7
#: Id after each document's tokens.
END_ID = 2
#: Centroid clustering: centroids, rounds, components of a vector, scale, seed.
CENTROIDS = dict(k=16, rounds=3, dim=64, scale=64, seed=1)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read_table(spark, sf_dir, "documents")).drop("spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    res = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return res.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return res.select("doc_id", "shard", "depth", "n_bytes")


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SMALL_SHARD_BYTES)
    return res.select("doc_id", "shard", "depth", "n_bytes")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED).select(
        "doc_id", "size", "source_size", "target", "taken")


def toxicity_scorer(spark: SparkSession, sf_dir: str) -> toxicity.Scorer:
    return toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    res = toxicity.score(docs, toxicity_scorer(spark, sf_dir))
    return res.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return tokenfiles.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"), **CENTROIDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash": op3_simhash,
    "op4_kdtree_topk": op4_kdtree_topk,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_sharding": op7_sharding,
    "sharding_small": sharding_small,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_files": op12_token_files,
    "op13_centroid_clustering": op13_centroid_clustering,
}

def _sharding_sql(limit: int) -> str:
    """The shortest prefix of each hash whose bucket fits, among all prefixes of all hashes."""
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT doc_id, n_bytes, h, k, h >> (60 - k) AS p FROM d, range(0, 61) AS g(k)),
b AS (SELECT k, p, sum(n_bytes) AS s, min(h) AS lo, max(h) AS hi FROM lv GROUP BY ALL),
f AS (SELECT lv.doc_id, lv.n_bytes, lv.h, min(lv.k) AS depth FROM lv JOIN b USING (k, p)
      WHERE b.s <= {limit} OR b.lo = b.hi GROUP BY ALL)
SELECT doc_id, 's' || CASE WHEN depth = 0 THEN '' ELSE right(bin(h | (1::BIGINT << 60)), 60)[1:depth] END AS shard, depth::INTEGER AS depth, n_bytes::BIGINT AS n_bytes FROM f"""


def _clustering_sql(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """Assignment and mean, round by round; components are whole numbers held as doubles."""
    apart = "(list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.m) + list_inner_product(c.m, c.m))::BIGINT"
    near = f"SELECT e.row_no, e.vec_id, e.v, c.c, {apart} AS d FROM e CROSS JOIN c{{i}} c QUALIFY row_number() OVER (PARTITION BY e.row_no ORDER BY d, c.c) = 1"
    parts = []
    for i in range(rounds):
        parts.append(f"""a{i} AS ({near.format(i=i)}),
u{i} AS (SELECT c, pos, sum(x::BIGINT)::HUGEINT AS s, count(*)::HUGEINT AS n
         FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim} + 1)) AS pos FROM a{i}) GROUP BY c, pos),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS m FROM u{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))""")
    return rf"""
WITH e AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT v AS m, (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v) - 1)::INTEGER AS c FROM e),
c0 AS (SELECT c, m FROM o WHERE c < {k}),
{", ".join(parts)},
z AS ({near.format(i=rounds)}),
t AS (SELECT c, list_transform(m, lambda x: x::BIGINT::VARCHAR) AS m FROM c{rounds})
SELECT z.vec_id, z.c AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(t.m, ',')) AS centroid_sha256
FROM z JOIN t USING (c)"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS t
      FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM r WHERE len(ws) >= 13)),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
g AS (SELECT DISTINCT r, i + k AS p FROM (SELECT w.r, w.i, unnest(range(13)) AS k FROM w JOIN f USING (t) WHERE w.doc_id > f.first)),
k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept
      FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM r) ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM r LEFT JOIN k USING (r)""",
    "op11_lexical_search": r"""
WITH t AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents, t),
x AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM x),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM x) GROUP BY r, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM (SELECT DISTINCT item_id, text FROM benchmark), t),
q AS (SELECT DISTINCT i, item_id, unnest(ts) AS term FROM i),
s AS (SELECT q.i, q.item_id, x.r, x.doc_id,
             sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN x USING (r), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_centroid_clustering": _clustering_sql(**CENTROIDS),
    "op4_kdtree_topk": r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_url_filter": r"""
WITH u AS (
  SELECT page_id, url IS NOT NULL AND strpos(url, '://') > 0 AS ok,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, CASE WHEN ok THEN rest ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
FROM h""",
    "op7_sharding": _sharding_sql(SHARD_BYTES),
    "sharding_small": _sharding_sql(SMALL_SHARD_BYTES),
    "op8_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS w FROM s),
lv(level, i) AS (
  SELECT (sum(total) / sum(w) FILTER (total > 0))::DOUBLE, 0 FROM w
  UNION ALL
  SELECT ((SELECT sum(total) FROM w) - (SELECT coalesce(sum(total * 3) FILTER (total * 3 < level * w), 0) FROM w))::DOUBLE
         / (SELECT sum(w) FILTER (NOT (total * 3 < level * w)) FROM w), i + 1 FROM lv WHERE i < 40),
t AS (SELECT *, least(total * 3.0::DOUBLE, (SELECT max(level) FROM lv) * w) AS target FROM w),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
x AS (SELECT *, CASE WHEN total > 0 THEN words // total ELSE 0 END AS whole FROM p),
r AS (
  SELECT d.doc_id, d.size, x.total AS source_size, x.target, x.whole, x.words - x.whole * x.total AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS FIRST, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM r""",
}
