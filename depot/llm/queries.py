"""The registered queries of the operators: name -> (query, SQL of the same rows or None).

Each reads whole tables and applies its operator with production parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.llm.decontam import contamination
from depot.llm.fertility import quality
from depot.llm.hardneg import hard_negatives
from depot.llm.kneser import language_scores
from depot.llm.packing import pack
from depot.llm.pii import private_data
from depot.llm.rangejoin import near_vectors
from depot.llm.search import search
from depot.llm.shared import tasks_find_package
from depot.llm.simhash import near_duplicates
from depot.llm.substrings import dedup
from depot.llm.tokens import read_tokens, write_tokens
from depot.llm.toxicity import toxicity
from depot.llm.warc import merged_index, read_captures, write_archives

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    tasks_find_package(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return private_data(documents(spark, sf))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), public_tokenizers.path(WORDS))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf), public_tokenizers.path(WORDS), 2))


def op4_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    return language_scores(documents(spark, sf))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).drop(
        "item_ids"
    )


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, n, array_to_string(w[start:start + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS start
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT doc_id, n, start, array_to_string(w[start:start + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS start
        FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, start FROM windows JOIN patterns USING (n, win)),
hit AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(start, start + n)) AS i FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(documents(spark, sf)).drop("kept")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
windows AS (
  SELECT doc_id, w, start, array_to_string(w[start:start + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS start FROM words)),
later AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op7_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return quality(documents(spark, sf), public_tokenizers.path(PIECES))


def captured_pages(pages: DataFrame) -> DataFrame:
    """Pages with a time of capture: their own `captured` where it is a time of 14 digits.

    The given pages have none. Page n then counts as captured n seconds into 2024, and from
    10 ** 9 seconds on (in 2055) again from its start, so that every id has a time.
    """
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    seconds = F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(10**9)), F.lit(0))
    time = F.date_format(start + F.make_dt_interval(secs=seconds), "yyyyMMddHHmmss")
    if "captured" in pages.columns:
        own = F.col("captured").cast("string")
        time = F.when(own.rlike("^[0-9]{14}$"), own).otherwise(time)
    return pages.select("page_id", "url", "html", time.alias("captured"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    tasks_find_package(spark)
    pages = captured_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    captures = read_captures(merged_index(write_archives(pages)))
    return captures.drop("url", "captured", "key_range", "place")


OP8_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) AS n,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op11_vector_join(spark: SparkSession, sf: str) -> DataFrame:
    tasks_find_package(spark)
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE ready AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS length
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND
              len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  WHERE list_inner_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ready a JOIN ready b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.length * b.length) >= 0.9),
reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON vec_id = c.a LEFT JOIN lowest l ON vec_id = l.a
"""


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
counts AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs)
  GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
item_terms AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM item_terms JOIN dfs USING (term), size),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) //
    (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM counts JOIN weights USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    tasks_find_package(spark)
    return hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP13_SQL = """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND
        len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM ready a JOIN ready r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


QUERIES = {
    "op1_personal_data": (op1_personal_data, None),
    "op2_packing": (op2_packing, None),
    "op3_token_files": (op3_token_files, None),
    "op4_kneser_ney": (op4_kneser_ney, None),
    "op5_decontamination": (op5_decontamination, OP5_SQL),
    "op6_substrings": (op6_substrings, OP6_SQL),
    "op7_fertility": (op7_fertility, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_simhash": (op9_simhash, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_vector_join": (op11_vector_join, OP11_SQL),
    "op12_ranked_search": (op12_ranked_search, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}
