"""Functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import VECTOR, HashingConfig, vectorize_texts
from lexmill.functions.text import _GENERAL, GERMAN, SPACE, TokenRules


def _literal(pattern: str) -> str:
    return pattern.replace("'", "''")


def register(spark: SparkSession, hashing: HashingConfig | None = None, rules: TokenRules = GERMAN) -> None:
    """Registers lm_normalize, lm_tokens, lm_token_type (SQL functions), lm_tokenize (a table
    function: pos, text, start, end) and, with a key, lm_vectorize of a normalised text."""
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    case = " ".join(f"WHEN t RLIKE '\\A(?:{_literal(p)})\\z' THEN '{k}'" for p, k in (*rules.rules, *_GENERAL))
    for name, args, kind, body in (
        ("lm_normalize", "t STRING", "STRING", rf"lower(regexp_replace(regexp_replace(t, '[\p{{Cntrl}}\s]+', ' '), '^[{SPACE}]+|[{SPACE}]+$', ''))"),
        ("lm_tokens", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, '([^{SPACE}]+)', 1)"),
        ("lm_token_type", "t STRING", "STRING", f"CASE {case} ELSE 'WORD_SYMBOL' END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.conf.unset("spark.sql.parser.escapedStringLiterals")

    @F.udtf(returnType="pos int, text string, start int, end int")
    class Tokens:
        def eval(self, text: str):
            import regex

            for k, m in enumerate(regex.finditer(f"[^{SPACE}]+", text or "")):
                yield k, m[0], m.start(), m.end()

    spark.udtf.register("lm_tokenize", Tokens)
    if hashing is not None:

        @F.arrow_udf(VECTOR)
        def vector(texts):
            import pyarrow as pa

            rows = [{"indices": i.tolist(), "values": v.tolist()} for i, v in vectorize_texts([t or "" for t in texts.to_pylist()], hashing)]
            return pa.array(rows, pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]))

        spark.udf.register("lm_vectorize", vector)
