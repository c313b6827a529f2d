import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T


def typed(spark, text, punctuation=False, rules=T.GERMAN):
    df = spark.createDataFrame([(text,)], "text string")
    c = T.tokenize_punctuation(F.col("text"), rules) if punctuation else T.tokenize(F.col("text"), rules)
    return [(t["text"], t["type"], t["start"], t["end"]) for t in df.select(c.alias("t")).first()["t"]]


@pytest.mark.parametrize(
    "text,types",
    [
        ("lantern", ["WORD"]),
        ("31.12.2024 31/12/24 2024-12-31", ["DATE"] * 3),
        ("1.234,56 12,50 12.50", ["AMOUNT"] * 3),
        ("1234", ["NUMERIC"]),
        ("AB12", ["ALPHANUMERIC"]),
        ("-->", ["SYMBOL"]),
        ("nut-m4 Policy:", ["WORD_SYMBOL"] * 2),
        ("   \t\n ", []),
        ("a\xa0b", ["WORD", "WORD"]),
        ("٣٤", ["SYMBOL"]),
    ],
)
def test_whitespace_types(spark, text, types):
    assert [t[1] for t in typed(spark, text)] == types


@pytest.mark.parametrize(
    "text,types",
    [
        ("Policy: Q7", ["WORD", "SYMBOL", "ALPHANUMERIC"]),
        ("2024-12-31 1.234,56", ["DATE", "AMOUNT"]),
        ("1234.567", ["NUMERIC"]),
        ("12AB", ["NUMERIC", "WORD"]),
        ("٣٤", ["NUMERIC"]),
    ],
)
def test_punctuation_types(spark, text, types):
    got = typed(spark, text, punctuation=True)
    assert [t[1] for t in got] == types
    assert all(text[s:e] == t for t, _, s, e in got)


def test_offsets_and_locales(spark):
    assert typed(spark, "ab  cd") == [("ab", "WORD", 0, 2), ("cd", "WORD", 4, 6)]
    assert [t[1] for t in typed(spark, "12/31/2024 1,234.56", rules=T.US)] == ["DATE", "AMOUNT"]
    assert [t[1] for t in typed(spark, "12.50", rules=T.US)] == ["AMOUNT"]
    custom = T.GERMAN.first((r"[A-Z]{2}-\d{3}", T.ALPHANUMERIC))
    assert typed(spark, "AB-123", True, custom) == [("AB-123", "ALPHANUMERIC", 0, 6)]
    with pytest.raises(ValueError):
        T.TokenRules(((".", "NOTHING"),))


def test_normalize(spark):
    df = spark.createDataFrame([("  Payment\t 1234.56  ON  2024-12-31 ",), ("\x00A\x1f b\xa0",), ("",), (None,)], "t string")
    once = T.normalize(F.col("t"))
    got = df.select(once.alias("a"), T.normalize(once).alias("b")).collect()
    assert [r.a for r in got] == ["payment 1234.56 on 2024-12-31", "a b", "", None]
    assert all(r.a == r.b for r in got)


def test_signature_and_spans(spark):
    df = spark.createDataFrame([("booked 2024-12-31",), ("",)], "t string")
    s = T.signature(T.token_types(F.col("t")))
    assert [r[0] for r in df.select(s).collect()] == ["<word> <date>", ""]
    df = spark.createDataFrame([("WMMMW",), ("",), (None,)], "c string")
    got = [r[0] for r in df.select(T.spans(F.col("c"), "M*")).collect()]
    assert [None if g is None else [(x["first"], x["last"]) for x in g] for g in got] == [[(1, 3)], [], None]


def test_sql_functions(spark):
    from lexmill.functions.hashing import HashingConfig
    from lexmill.functions.sql import register

    register(spark, HashingConfig(1, 2))
    assert spark.sql("SELECT lm_normalize(' A  b') AS x").first().x == "a b"
    assert spark.sql("SELECT transform(lm_tokens('ab 12,50'), t -> t) AS x").first().x == ["ab", "12,50"]
    assert spark.sql("SELECT lm_token_type('12,50') AS x").first().x == "AMOUNT"
    assert [tuple(r) for r in spark.sql("SELECT * FROM lm_tokenize('ab  cd')").collect()] == [(0, "ab", 0, 2), (1, "cd", 4, 6)]
    assert len(spark.sql("SELECT lm_vectorize('abc') AS v").first().v["indices"]) == 1
