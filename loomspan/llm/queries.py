"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, langid, neardup, negatives, ogg, packing, quality, quality_model, sharding, sst, suffix, urlfilter, vacode
from .common import read_table

RULES = [
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), codec.tokenizer_path(), 4096, 1)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=("held_out",)).drop("langs")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.text_media(read_table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = codec.tokenizer_path()
    return codec.encode_documents(docs, path, codec.build_lexicon(docs, path))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.round_trip(spark, read_table(spark, sf_dir, "documents"), codec.tokenizer_path(), 2)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), 40)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacode.vector_codes(read_table(spark, sf_dir, "embeddings"))


def kept_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), kept_out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), label=label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_minhash_near_dedup, op3_language_id, op4_url_filters, op5_quality_rules,
        op6_media_columns, op7_bpe_codec, op8_suffix_array_dedup, op9_token_tables, op10_sharding,
        op11_vector_codes, op12_quality_classifier, op13_hard_negatives,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCALED = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"


def _assigned(name: str, books: str) -> str:
    """SQL of a table with each part's nearest entry."""
    return f"""{name} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (
    SELECT p.*, c.k, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS d FROM p JOIN {books} c USING (part)) GROUP BY vec_id, part)"""


def _renewed(name: str, books: str, assigned: str) -> str:
    """SQL of a codebook with the means of what is assigned; unused entries stay."""
    return f"""{name} AS MATERIALIZED (SELECT part, k, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN (SELECT part, k, list(f ORDER BY j) AS x FROM (
    SELECT part, k, j, floor(sum(x[j]) / count(*)) AS f FROM (SELECT part, k, x, unnest(range(1, len(x) + 1)) AS j FROM {assigned}) GROUP BY ALL) GROUP BY ALL) m USING (part, k))"""


#: Packing, languages, media, ids, repeats, files, hashed shards and fitted scores are beyond SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i + 1]) ELSE w END) AS s FROM w),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
  e AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
  r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT x.b, r.root FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = r.doc_id)
  SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op4_url_filters": f"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
  r(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
  SELECT page_id, host, path, arg_max(h||p, length(h||p) * 1000 + length(h)) AS rule, coalesce(arg_max(v, length(h||p) * 1000 + length(h)), 'allow') AS verdict
  FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.'||h)) AND starts_with(path, p) GROUP BY page_id, host, path""",
    "op5_quality_rules": f"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM documents),
  u AS (SELECT doc_id, i, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i : i + 4], ' ') END AS g, w[i] = w[i - 1] AND i > 1 AS same FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
  v AS (SELECT doc_id, i, same, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM u),
  x AS (SELECT doc_id, same, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM v),
  y AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS n_repeat_words, count(*) FILTER (same) AS stutter FROM x GROUP BY doc_id),
  z AS (SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stutter, 0) AS stutter,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS cased FROM t LEFT JOIN y USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR (2 * upper > cased AND cased >= 40) OR 4 * stutter > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM z""",
    "op11_vector_codes": f"""WITH v AS MATERIALIZED (SELECT vec_id, label, {_SCALED} AS v FROM embeddings WHERE {_WHOLE}),
  p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM (SELECT *, unnest(range(16)) AS part FROM v)),
  f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= 64),
  b0 AS MATERIALIZED (SELECT part, k, x FROM p JOIN f USING (vec_id)), {_assigned("a0", "b0")}, {_renewed("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_renewed("b2", "b1", "a1")}, {_assigned("a2", "b2")},
  e AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
  h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, k, j)) AS h FROM (SELECT part, k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM b2))
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), h""",
    "op13_hard_negatives": f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_SCALED} AS v FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
  s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS MATERIALIZED (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
  n AS (SELECT a, p, b, ps, s, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) AS r FROM p JOIN s USING (a) WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps)
  SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 10""",
}
