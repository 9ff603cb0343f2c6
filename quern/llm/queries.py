"""The query of each operator, over whole tables with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.best_fit import best_fit
from quern.llm.common import table
from quern.llm.context_mixing import lm_scores
from quern.llm.exact_topk import exact_topk
from quern.llm.filter_audit import filter_audit
from quern.llm.html_text import html_text
from quern.llm.jaccard_join import jaccard_groups
from quern.llm.license_scan import license_scan
from quern.llm.periodic_runs import run_digest
from quern.llm.quality_rules import quality_rules
from quern.llm.sentence_pieces import sentencepiece_decode, sentencepiece_encode
from quern.llm.source_mix import source_mix
from quern.llm.token_counts import token_counts
from quern.llm.url_filter import CATEGORIES, COUNTRIES, url_filter


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file on this machine; the package is installed on all of them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


_OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("word_bpe_49k.json")).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text(pages).drop("html")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).drop("text")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, table(spark, sf_dir, "labels")).drop("url")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY 1),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask, coalesce(q, 0) AS q, coalesce(x, 0) AS x FROM w LEFT JOIN marks USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(range(5)) AS k),
orders AS (SELECT a.k AS k1, b.k AS k2, c.k AS k3, d.k AS k4, e.k AS k5 FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
steps AS (SELECT chr(65 + k1::INT) || chr(65 + k2::INT) || chr(65 + k3::INT) || chr(65 + k4::INT) || chr(65 + k5::INT) AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
  unnest([1 << k1, 1 << k2, 1 << k3, 1 << k4, 1 << k5]) AS bit, unnest([0, 1 << k1, (1 << k1) + (1 << k2), (1 << k1) + (1 << k2) + (1 << k3), 31 - (1 << k5)]) AS earlier FROM orders),
told AS (SELECT part, filter_order, step::INTEGER AS step, bit, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM h, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told"""


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    pieces = sentencepiece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    told = pieces.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), covered.alias("span_bytes"))
    return sentencepiece_decode(told, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "span_bytes")


def _op9_sql() -> str:
    one_of = lambda x, names: f"{x} IN ({', '.join(map(repr, names))})"
    two = f"{one_of('parts[-1]', COUNTRIES)} AND len(parts) > 1 AND {one_of('parts[-2]', CATEGORIES)}"

    def level(name: str, source: str) -> str:
        """The posterior of a level, from rows with n, k and prior."""
        return rf"""
{name}_rho AS (SELECT sum(pow(k / n - prior, 2) * n - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) AS r FROM {source} WHERE n > 0),
{name}_s AS (SELECT CASE WHEN r > 0 THEN greatest(least(1 / r - 1, 10000.0), 1.0) ELSE 10000.0 END AS s FROM {name}_rho),
{name} AS (SELECT g.*, (least(s, rests) * prior + k) / (least(s, rests) + n) AS rate, least(s, rests) + n AS size FROM {source} g, {name}_s)"""

    return rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
told AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcomes AS (SELECT doc_id AS page, max(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
known AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM (SELECT DISTINCT page_id AS page, host FROM told) LEFT JOIN outcomes USING (page) GROUP BY 1),
named AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '.') AS parts, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name FROM known),
hosts AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k,
  CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN name WHEN {two} THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
  CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN '' WHEN {two} THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM named),
suffix_in AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS prior, (SELECT sum(n) + 2 FROM hosts) AS rests FROM hosts GROUP BY 1), {level("suffixes", "suffix_in")},
domain_in AS (SELECT h.*, rate AS prior, size AS rests FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2) h JOIN suffixes USING (suffix)), {level("domains", "domain_in")},
host_in AS (SELECT h.host, h.n, h.k, d.rate AS prior, d.size AS rests FROM hosts h JOIN domains d USING (domain, suffix)), {level("posterior", "host_in")},
rated AS (SELECT host, rate AS bad_rate, greatest(rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)), 0.0) AS bad_low FROM posterior),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM told)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad_low > (SELECT 2 * m / (1 - m + 2 * m) FROM (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM hosts)) THEN 'block' ELSE 'allow' END AS verdict,
  round(bad_rate, 6) AS bad_rate, round(bad_low, 6) AS bad_low FROM ruled LEFT JOIN rated USING (host)"""


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_lm_scores, op3_exact_topk, op4_token_counts, op5_quality_rules, op6_html_text, op7_best_fit, op8_license_scan, op9_url_filter, op10_jaccard_join, op11_periodic_runs, op12_filter_audit, op13_sentence_pieces)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op3_exact_topk": _OP3_SQL, "op9_url_filter": _op9_sql(), "op12_filter_audit": _OP12_SQL}
