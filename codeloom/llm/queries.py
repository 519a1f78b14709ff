"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.divergence import divergence_audit
from codeloom.llm.html_extract import extract_main_text
from codeloom.llm.language_model import language_model_scores
from codeloom.llm.near_dedup import hex_digits, near_duplicate_classes
from codeloom.llm.packing import pack
from codeloom.llm.pseudonyms import pseudonymise
from codeloom.llm.quality import held_out, quality_scores
from codeloom.llm.set_join import Likeness, jaccard_components
from codeloom.llm.sharding import hilbert_shards
from codeloom.llm.topk import exact_top_k
from codeloom.llm.url_filter import match_rules
from codeloom.llm.vector_codes import vector_codes
from codeloom.sources.tables import table

#: Verdict, host and path of each URL rule.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: The key of the registered query; a real run passes a secret one.
PSEUDONYM_KEY = "registered query"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "text", "n_private", "private_kinds")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues")


def op5_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return classes.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), train_on=~held_out("doc_id", 5, 0), threshold=0.3)
    return scores.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), train_on=~held_out("doc_id", 7, 2))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return match_rules(table(spark, sf_dir, "pages"), rules)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, like=Likeness(9, 10))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"), least_docs=10, k=10)


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM d, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON win.n = g.n AND win.phrase = g.phrase
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL_URLS = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parsed AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN LATERAL (
  SELECT rules.host || rules.path AS rule, rules.verdict FROM rules
  WHERE (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC LIMIT 1
) r ON true
"""


def sql_codebooks(parts: int, entries: int, rounds: int) -> str:
    """Lloyd's rounds as a chain of tables: part codes of vectors (p), codebooks (c0 to c{rounds}), assignments (a0 to a{rounds})."""
    chain = [
        f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, k AS part, e[CAST(k * len(e) / {parts} AS BIGINT) + 1 : CAST((k + 1) * len(e) / {parts} AS BIGINT)] AS x
  FROM v, range({parts}) AS t(k)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""
    ]
    for n in range(rounds + 1):
        chain.append(f"""
a{n} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, p.x,
    min({{'d': CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT), 'entry': c.entry}}) AS best
  FROM p JOIN c{n} c ON c.part = p.part GROUP BY ALL
)""")
        if n < rounds:
            chain.append(f"""
m{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, best.entry AS entry, i, floor(sum(x[i + 1]) / count(*)) AS m
    FROM a{n}, unnest(range(len(x))) AS t(i) GROUP BY ALL
  ) GROUP BY ALL
), c{n + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry
)""")
    return f"""
WITH {",".join(chain)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(CAST(CAST(x[i + 1] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM c{rounds}, unnest(range(len(x))) AS t(i)
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books
"""


SQL_JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g
  FROM d
), u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

SQL_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS MATERIALIZED (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t GROUP BY ALL),
full_counts AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, total, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n
  FROM grp JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, c, 1 + 1000000000 * (c + 2) // (f.n + 2 * v) AS p, 1 + 1000000000 * (total + 2) // (size.n + 2 * v) AS q
  FROM full_counts f JOIN size USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), whole_pair AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
), rows_of AS (
  SELECT lang, source, 'pair' AS part, item, value FROM whole_pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows_of
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pseudonyms": op1_pseudonyms,
        "op2_decontaminate": op2_decontaminate,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_packing": op4_packing,
        "op5_simhash_classes": op5_simhash_classes,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_quality": op7_quality,
        "op8_language_model": op8_language_model,
        "op9_url_filter": op9_url_filter,
        "op10_html_text": op10_html_text,
        "op11_vector_codes": op11_vector_codes,
        "op12_ngram_join": op12_ngram_join,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": SQL_DECONTAMINATE, "op6_exact_top_k": SQL_TOP_K, "op9_url_filter": SQL_URLS, "op11_vector_codes": sql_codebooks(4, 256, 4), "op12_ngram_join": SQL_JACCARD, "op13_source_divergence": SQL_DIVERGENCE}
