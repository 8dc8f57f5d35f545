"""Registered queries of the llm operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.llm import (
    decontamination, embedding_dedup, hard_negatives, html_text, language, licenses, ngram_join, pieces, quality, ranked_search, token_files, toxicity, url_filter,
)
from courtspark.llm.common import table
from courtspark.registry.entry import Query


def op1(spark, sf_dir):
    return decontamination.report(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5(spark, sf_dir):
    """Documents have no path of their own: the source and the language are taken as folders."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))))
    return licenses.scan(docs)


def op4(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "n_bytes", "ids_crc32", "verified")


def op6(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


def op7(spark, sf_dir):
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


def op9(spark, sf_dir):
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    labelled = url_filter.labels_of_pages(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op11(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark, sf_dir):
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents")).drop("parts")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS words FROM (
    SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), spots AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS words FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, s, size, item_id FROM spots JOIN windows USING (size, words)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.size + q.size - shared)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION SELECT root, y FROM reach JOIN links ON x = node
)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE node = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS root, vec_id AS node FROM embeddings
  UNION SELECT root, y FROM reach JOIN links ON x = node
), named AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node
), counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counts USING (vec_id)
"""

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), totals AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS every FROM d WHERE len(w) > 0
), asked AS (SELECT DISTINCT q, unnest(w) AS t FROM i
), tf AS (
  SELECT k, t, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY k, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, totals GROUP BY t, docs
), parts AS (
  SELECT k, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w)::BIGINT * docs) // every))) AS part
  FROM tf JOIN weights USING (t) JOIN d USING (k), totals
), scores AS (SELECT q, k, sum(part)::BIGINT AS score FROM asked JOIN parts USING (t) GROUP BY q, k HAVING sum(part) > 0
), ranked AS (SELECT q, k, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores JOIN d USING (k))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN d USING (k) JOIN i USING (q) WHERE rank <= 50
"""

OP12_SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: floor(256 * x)) AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

QUERIES: dict[str, Query] = {
    "op1_benchmark_decontamination": Query(op1, OP1_SQL),
    "op2_sentencepiece": Query(op2),
    "op3_html_extraction": Query(op3),
    "op5_license_scan": Query(op5),
    "op4_ngram_jaccard_join": Query(op4, OP4_SQL),
    "op6_quality_classifier": Query(op6),
    "op7_token_files": Query(op7),
    "op8_toxicity": Query(op8),
    "op9_embedding_dedup": Query(op9, OP9_SQL),
    "op10_url_filter": Query(op10),
    "op11_ranked_search": Query(op11, OP11_SQL),
    "op12_hard_negatives": Query(op12, OP12_SQL),
    "op13_language_id": Query(op13),
}
