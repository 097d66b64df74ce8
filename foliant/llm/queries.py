"""Queries over the test tables, one for each numbered operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, htmltext, langid, neardup, quality, resample, rules, secretscan, simhash, tokenfiles, unigram


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels.where(~held_out()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality_model(docs, table(spark, sf_dir, "labels")), name="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.report(docs, rules.ratios(docs, table(spark, sf_dir, "labels").where("quality = 1"))).drop("log_ratio")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.encode_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.report(docs, secretscan.fit(docs))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT p.doc_id, p.k, p.n, windows.item_id
  FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)) p
  JOIN windows ON windows.n = p.n AND windows.s = p.s),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: The fixed values 4, 14 bits (16384 buckets), 16777619, 2654435761, -0.25 and 50 are those of rules.py and features.py.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, k, count(*) OVER (PARTITION BY r, a) AS n FROM (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS a FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM b))),
repeats AS (SELECT r, count(DISTINCT pos) AS n_repeat FROM (SELECT r, unnest(range(k, k + 3)) AS pos FROM windows WHERE n > 1) GROUP BY 1),
bytes AS (SELECT r, doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM (SELECT r, doc_id, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda y: CAST('0x' || y AS BIGINT)) AS x FROM d)),
quads AS (SELECT r, doc_id, v AS a, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS e FROM bytes WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, doc_id, CAST((CAST(h4 AS HUGEINT) * 2654435761 % 4294967296) // 262144 AS BIGINT) AS g FROM (SELECT r, doc_id, xor(h3 * 16777619 % 4294967296, e) AS h4 FROM (SELECT *, xor(h2 * 16777619 % 4294967296, c) AS h3 FROM (SELECT *, xor(h1 * 16777619 % 4294967296, b) AS h2 FROM (SELECT *, xor(CAST(4 AS BIGINT) * 16777619 % 4294967296, a) AS h1 FROM quads WHERE e IS NOT NULL))))),
per AS (SELECT r, g, count(*) AS n FROM grams GROUP BY ALL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
buckets AS (SELECT g, sum(n) AS raw, coalesce(sum(n) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)), 0) AS target FROM (SELECT per.*, doc_id FROM per JOIN d USING (r)) GROUP BY 1),
sums AS (SELECT sum(raw) + 16384 AS all_raw, sum(target) + 16384 AS all_target, sum(target) AS any_target FROM buckets),
ratio AS (SELECT g, CASE WHEN any_target = 0 THEN 0 ELSE ln((target + 1) / all_target) - ln((raw + 1) / all_raw) END AS x FROM buckets, sums),
score AS (SELECT r, sum(n * x) / sum(n) AS mean FROM per JOIN ratio USING (g) GROUP BY 1),
counts AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(mean, 0) AS mean FROM b LEFT JOIN repeats USING (r) LEFT JOIN score USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND mean >= -0.25 AS kept FROM counts
"""


#: CRC-32 by its polynomial: a table of 256 remainders, then byte by byte over each distinct feature.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT n, 0 AS k, n AS c FROM range(256) x(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, w[k] || ' ' || w[k + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS k FROM d)),
fi AS (SELECT unnest(w) AS f FROM i UNION ALL SELECT w[k] || ' ' || w[k + 1] FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda y: CAST('0x' || y AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS g
  FROM (SELECT f FROM fd UNION SELECT f FROM fi), crc),
s AS (SELECT g, count(*) AS n FROM fd JOIN hashed USING (f) GROUP BY g),
t AS (SELECT g, count(*) AS n FROM fi JOIN hashed USING (f) GROUP BY g),
gain AS (
  SELECT s.g, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (a.all_s + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (b.all_t + 10000)))) AS BIGINT) AS v
  FROM s LEFT JOIN t USING (g), (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS all_s FROM s) a, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS all_t FROM t) b),
weights AS (SELECT r, count(*) AS n, CAST(floor(sum(v) / count(*)) AS BIGINT) AS weight FROM fd JOIN hashed USING (f) JOIN gain USING (g) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS p, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 25 * placed.n // 100 THEN p END AS rank FROM scored LEFT JOIN placed USING (r)
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(length(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x FROM d),
c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS i, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS j,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (SELECT *, substr(t, 1, i) AS prefix, substr(t, i + 1, j - i) AS middle, substr(t, j + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_quality, op3_token_files, op4_main_text, op5_decontaminate, op6_secrets, op7_byte_bpe, op8_token_counts, op9_rules, op10_simhash, op11_resample, op12_vectors, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op9_rules": OP9_SQL, "op11_resample": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
