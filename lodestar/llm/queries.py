"""Queries that apply each operator to its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, toxicity
from .decontaminate import find_passages
from .html_text import main_text
from .line_dedup import dedup_lines
from .near_duplicates import near_duplicates
from .packing import pack
from .pii import find_personal_data
from .quality import BOILERPLATE, clean_lines
from .resample import resample
from .secrets import find_secrets
from .shared import new_path, table
from .spelling import spelling_variants
from .token_counts import token_counts


def held_out(column: str, parts: int, which: int) -> Column:
    """Whether a row is kept from learning: by the CRC-32 of its id as text. Rows without an id are."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == which, F.lit(True))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.train(docs, labels, ~held_out("id", 3, 1)))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_toxic_sentences"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).drop("sanitised")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score(docs, language_model.train(docs, ~held_out("doc_id", 7, 2)))
    return out.withColumn("held_out", held_out("doc_id", 7, 2))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100).drop("text_key")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that each run counts every text and none depends on an earlier one."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_language_model": op5_language_model,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_secrets": op10_secrets,
    "op11_token_counts": op11_token_counts,
    "op12_resampling": op12_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
classes AS (SELECT list_sort(s) AS k, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM (SELECT g.* FROM grams g JOIN classes c ON g.doc_id = c.rep) a
  JOIN (SELECT g.* FROM grams g JOIN classes c ON g.doc_id = c.rep) b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT rep AS x, rep AS y FROM classes
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least.c, s.doc_id) AS component_id,
  coalesce(least.c, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.k LEFT JOIN least ON least.x = c.rep
"""

OP2_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r
), lines AS (
  SELECT r, l, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM texts)
), judged AS (
  SELECT r, l, len(w) AS n,
    length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) >= 0.1::DOUBLE * length(l)
    OR len(list_filter(w, lambda x: x IN ('|', '»', '›', '•', '·', '/', '::', '>'))) >= 0.25::DOUBLE * len(w)
    OR len(list_filter(w, lambda x: x LIKE '%!!')) >= 0.5::DOUBLE * len(w)
    OR len(w) <= 40 AND (regexp_matches(l, '@BOILERPLATE@') OR len(w) >= 4 AND NOT regexp_matches(l, '[.!?…。！？:;"''”’»)\]][\x20\x09-\x0D]*\z')) AS fails
  FROM lines WHERE len(w) > 0
), by_doc AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (fails) AS removed, coalesce(sum(n) FILTER (NOT fails), 0) AS left_words
  FROM judged GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w)) AND coalesce(left_words, 0) >= 0.5::DOUBLE * len(w) AS kept,
  coalesce(removed, 0)::BIGINT AS n_lines_removed, coalesce(left_words, 0)::BIGINT AS n_words_kept
FROM words LEFT JOIN covered c USING (r) LEFT JOIN by_doc USING (r)
""".replace("@BOILERPLATE@", BOILERPLATE)

#: The CRC-32 of the UTF-8 bytes of each s of strings, by the usual table of 256 entries.
CRC_SQL = r"""lookup AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i)
), coded AS (
  SELECT s, xor(list_reduce(
    list_transform(range(1, strlen(s)::BIGINT + 1), lambda i: 16 * (strpos('0123456789ABCDEF', substr(hex(s), 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(s), 2 * i, 1)) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM strings, lookup
)"""

OP12_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts
), runs AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM words
), strings AS (SELECT DISTINCT s FROM runs), @CRC@,
features AS (SELECT side, r, crc % 10000 AS bucket FROM runs JOIN coded USING (s)),
sums AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features GROUP BY bucket),
totals AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features),
gains AS (
  SELECT bucket, floor(1000 * ln((g.t + 1)::DOUBLE * (a.s + 10000) / ((g.s + 1)::DOUBLE * (a.t + 10000)))) AS gain FROM sums g, totals a
), weighed AS (
  SELECT r, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
""".replace("@CRC@", CRC_SQL)

OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY id, run),
strings AS (SELECT id || run AS s FROM counted), @CRC@,
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 97 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, n FROM counted JOIN coded ON s = id || run
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (SELECT DISTINCT word, i, word[:i - 1] || word[i + 1:] AS l FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.l = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.l = b.word
), best AS (
  SELECT x AS word, count(*) AS n_near, arg_min(y, (-v.n, hex(y))) AS near, max(v.n) AS most FROM pairs JOIN words v ON v.word = y GROUP BY x
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
), ends AS (SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
""".replace("@CRC@", CRC_SQL)

ORACLE_SQL = {"op2_quality_rules": OP2_SQL, "op7_near_duplicates": OP7_SQL, "op12_resampling": OP12_SQL, "op13_spelling_variants": OP13_SQL}
