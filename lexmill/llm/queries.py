"""The corpus operators' queries: whole tables in, the contract's columns out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """LEXMILL_TOKENIZER, or the public file ``byte_bpe_50k.json``."""
    if at := os.environ.get("LEXMILL_TOKENIZER"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.exact_dedup import assign

    return assign(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS n, length(translate(coalesce(text, ''), '!#$%&*|~^=+<>{}', '')) AS plain
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN n = 0 THEN 0.05::DOUBLE ELSE greatest(0.05::DOUBLE, 1::DOUBLE - (n - plain)::DOUBLE / n::DOUBLE) END AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)]::DOUBLE AS w,
         row_number() OVER (ORDER BY source IS NULL, source) AS pos, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w < cap THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""

QUERIES = {"op3_bpe": op3_bpe, "op4_mixing": op4_mixing, "op7_exact_dedup": op7_exact_dedup}
ORACLE = {"op4_mixing": OP4_SQL, "op7_exact_dedup": OP7_SQL}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.simhash import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES |= {"op1_simhash": op1_simhash, "op2_token_files": op2_token_files}


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.minhash import edited_next

    return edited_next(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


QUERIES |= {"op8_minhash": op8_minhash, "op9_substring_dedup": op9_substring_dedup}


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import score

    return score(table(spark, sf_dir, "documents"))


QUERIES |= {"op10_quality": op10_quality}


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.html_extract import extract_main

    return extract_main(table(spark, sf_dir, "pages"))


QUERIES |= {"op5_html": op5_html}


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.warc import derivatives, pages_to_responses

    return derivatives(pages_to_responses(table(spark, sf_dir, "pages"), carry=("page_id",)), carry=("page_id",))


QUERIES |= {"op6_warc": op6_warc}

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, md5(string_agg(word, ' ') OVER f) AS h, count(*) OVER f AS n
      FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT h, min(doc_id) AS earliest FROM g WHERE n = 50 GROUP BY h),
r AS (SELECT g.doc_id, i, word, coalesce(n = 50 AND earliest < doc_id, false) AS bad FROM g LEFT JOIN m USING (h)),
c AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, count(i) AS n_words, count(i) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""

ORACLE |= {"op9_substring_dedup": OP9_SQL}
