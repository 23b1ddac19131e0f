"""One query for each operator, over its whole table and with the parameters meant for production, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm import captures, decontaminate, jaccard, languages, linededup, mixing, preferences, quality, tokencount, toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rated = quality.rate(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", "quality_probability", "quality_rating", "quality_keep")


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate(docs.select("doc_id", "text"), model).select("doc_id", "toxic_probability", "toxic")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = languages.identify(docs.select("doc_id", "text"), *languages.train(docs))
    return rated.select("doc_id", "language", "languages", "shares", "segments")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


ORACLE_SQL["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lists AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS gs FROM words WHERE len(w) > 0
), keyed AS (SELECT doc_id, md5(array_to_string(gs, ',')) AS k, gs FROM lists
), sets AS (SELECT k, any_value(gs) AS gs, count(*) - 1 AS copies, min(doc_id) AS first FROM keyed GROUP BY k
), grams AS (SELECT k, len(gs) AS n, unnest(gs) AS g FROM sets
), pairs AS (
  SELECT a.k AS x, b.k AS y FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9
), reach AS (SELECT k AS x, k AS y FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), least AS (SELECT r.x AS k, min(s.first) AS class_id FROM reach r JOIN sets s ON s.k = r.y GROUP BY r.x
), links AS (SELECT x AS k, count(*) AS links FROM pairs GROUP BY x
)
SELECT d.doc_id, coalesce(l.class_id, d.doc_id) AS class_id, CAST(coalesce(s.copies, 0) AS BIGINT) AS copies, CAST(coalesce(n.links, 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN keyed USING (doc_id) LEFT JOIN sets s USING (k) LEFT JOIN least l USING (k) LEFT JOIN links n USING (k)
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_lines(docs)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "n_tokens", "rate", "copies")


@query
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = captures.build(pages)
    found = captures.lookup(index, pages.select(captures.url_key(F.col("url")).alias("key")))
    return found.select("page_id", "url", "url_key", F.length("html").cast("long").alias("html_chars"), F.md5("html").alias("html_md5"))


ORACLE_SQL["op6_warc_index"] = r"""
WITH parts AS (
  SELECT page_id, url, html, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?', ['host', 'port', 'path', 'query']) AS p
  FROM pages WHERE url IS NOT NULL
)
SELECT page_id, url, array_to_string(list_reverse(string_split(lower(p.host), '.')), ',') || ')' || p.port || p.path || p.query AS url_key,
  CAST(length(html) AS BIGINT) AS html_chars, md5(html) AS html_md5
FROM parts
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_redacted(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preferences.conversations(table(spark, sf_dir, "conversations"))
    return preferences.format_pairs(preferences.lent_pairs(convs))


ORACLE_SQL["op10_preference_formatting"] = r"""
WITH convs AS (
  SELECT conv_id AS conv, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), answers AS (
  SELECT conv, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last_turn FROM convs
), lent AS (
  SELECT conv, turns, last_turn, coalesce(lead(conv) OVER w, first(conv) OVER v) AS other, coalesce(lead(turns[last_turn]) OVER w, first(turns[last_turn]) OVER v) AS answer
  FROM answers WHERE last_turn IS NOT NULL
  WINDOW w AS (PARTITION BY conv // 1024 ORDER BY conv), v AS (PARTITION BY conv // 1024 ORDER BY conv ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), pairs AS (
  SELECT conv AS chosen_id, other AS rejected_id, turns AS chosen, list_append(turns[1:last_turn - 1], answer) AS rejected FROM lent
), cut AS (
  SELECT *, list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 2), lambda i: i > len(chosen) OR i > len(rejected) OR chosen[i] <> rejected[i])) - 1 AS n FROM pairs
), parts AS (
  SELECT chosen_id, rejected_id, n, chosen[1:n] AS shared, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM cut
), ends AS (
  SELECT *, list_transform(range(1, len(c) + 1), lambda i: list_sum(list_transform(c[1:i], lambda t: length(t.role) + length(t.text) + 13))) AS ce,
    list_transform(range(1, len(r) + 1), lambda i: list_sum(list_transform(r[1:i], lambda t: length(t.role) + length(t.text) + 13))) AS re FROM parts
), out AS (
  SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS prompt_turns,
    array_to_string(list_transform(shared, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
    array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
    array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
    array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: CAST(CAST(ce[i] AS BIGINT) - length(c[i].text) - 8 AS VARCHAR) || '-' || CAST(CAST(ce[i] AS BIGINT) - 1 AS VARCHAR)), ',') AS chosen_mask,
    array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: CAST(CAST(re[i] AS BIGINT) - length(r[i].text) - 8 AS VARCHAR) || '-' || CAST(CAST(re[i] AS BIGINT) - 1 AS VARCHAR)), ',') AS rejected_mask
  FROM ends
)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM out
"""
