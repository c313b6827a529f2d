import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import extraction as X
from lexmill.operators import schema as S
from lexmill.operators import store as O
from lexmill.operators import tagging, vocabulary


def vocab(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, count long")


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize(
    "known,text,want",
    [
        (["lantern"], "lan tern", "lantern"),
        (["harbour", "old"], "old harbour", "old harbour"),
        (["harbour", "lantern", "old", "and"], "old har bour and lan tern", "old harbour and lantern"),
        (["thunderstorm"], "thun der storm", "thunderstorm"),
        (["storm", "thunderstorm"], "thunder storm", "thunderstorm"),
        (["harbour"], "qqq", "qqq"),
        (["lantern"], "lan trn", "lantrn"),
        (["old"], " \t ", ""),
    ],
)
def test_repair(spark, known, text, want, limit):
    df = spark.createDataFrame([(1, text)], "i int, text string")
    assert vocabulary.repair(df, vocab(spark, *known), broadcast_words=limit).first().repaired == want


def test_near_words(spark):
    v = vocab(spark, "lantern", "harbour", "pattern")
    q = spark.createDataFrame([("lantrn",), ("harbeur",), ("zzz",), ("ltrn",), ("pattern",), ("patterns",)], "query string")
    assert sorted(map(tuple, vocabulary.near_words(q, v).collect())) == [("harbeur", "harbour"), ("lantrn", "lantern"), ("pattern", "pattern"), ("patterns", "pattern")]



def test_frequencies(spark, tmp_path):
    df = spark.createDataFrame([(w,) for w in ["Harbour", "harbour", "HARBOUR", "john", " ", None, "smith"]], "word string")
    full = vocabulary.word_frequencies(df)
    assert {r.word: r["count"] for r in full.collect()} == {"harbour": 3, "john": 1, "smith": 1}
    assert [r.word for r in vocabulary.word_frequencies(df, at_least=2).collect()] == ["harbour"]
    twice = vocabulary.add_frequencies(full, full)
    assert {r.word: r["count"] for r in twice.collect()}["john"] == 2
    vocabulary.save_frequencies(full, f"{tmp_path}/f", 2)
    back, at_least = vocabulary.load_frequencies(spark, f"{tmp_path}/f")
    assert at_least == 2 and [tuple(r) for r in back.collect()] == [("harbour", 3)]


# -- extraction --------------------------------------------------------------------------------
def fields(spark, text, *slots):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(X.extract(T.tokenize(F.col("text")), list(slots)).alias("f")).first().f
    return [(f["name"], f["value"], f["group_index"]) for f in got]


def test_slots(spark):
    assert fields(spark, "alpha beta gamma", X.PositionalSlot("x", 1), X.PositionalSlot("y", 9), X.PositionalSlot("z", -1)) == [("x", "beta", None)]
    assert fields(spark, "ref Policy: -- Q7 of Z99", X.KeyAnchoredSlot("p", "policy", T.ALPHANUMERIC)) == [("p", "Q7", None)]
    assert fields(spark, "(POLICY) next", X.KeyAnchoredSlot("p", "Policy")) == [("p", "next", None)]
    assert fields(spark, "Policy", X.KeyAnchoredSlot("p", "policy")) == [] == fields(spark, "no key", X.KeyAnchoredSlot("p", "policy"))
    group = X.RepeatingGroupSlot((("part", T.WORD_SYMBOL), ("price", T.AMOUNT)))
    assert fields(spark, "bolt-m4 1.10 and nut-m4 0.25 bolt-m5", group) == [("part", "bolt-m4", 0), ("price", "1.10", 0), ("part", "nut-m4", 1), ("price", "0.25", 1)]
    df = spark.createDataFrame([("a b",)], "text string").select(X.extract(T.tokenize(F.col("text")), [X.PositionalSlot("x", 1)]).alias("f"))
    assert df.select(X.first_of(F.col("f"), "x")).first()[0] == "b" and df.select(X.first_of(F.col("f"), "q")).first()[0] is None


@pytest.mark.parametrize(
    "text,pattern,ranges",
    [
        ("booked 2024-12-31 amount 12.50", X.TokenPattern.of(T.WORD, T.DATE), [(0, 1)]),
        ("sum 1.00 2.00 3.00", X.TokenPattern.of(T.WORD, (T.AMOUNT, X.MANY)), [(0, 3)]),
        ("total : 12.50", X.TokenPattern.of(T.WORD, (T.SYMBOL, X.OPTIONAL), T.AMOUNT), [(0, 2)]),
        ("total 12.50", X.TokenPattern.of(T.WORD, (T.SYMBOL, X.OPTIONAL), T.AMOUNT), [(0, 1)]),
        ("a b", X.TokenPattern.of((T.AMOUNT, X.ANY)), []),
    ],
)
def test_find_all(spark, text, pattern, ranges):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(X.find_all(T.tokenize(F.col("text")), pattern).alias("m")).first().m
    assert [(m["first"], m["last"]) for m in got] == ranges


def test_matches_fully(spark):
    p = X.TokenPattern.of(T.WORD, T.AMOUNT)
    df = spark.createDataFrame([("amount 12.50",), ("amount 12.50 extra",), ("",)], "text string")
    assert [r[0] for r in df.select(X.matches_fully(T.token_types(F.col("text")), p)).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        X.TokenPattern.of()


def test_clusters(spark):
    df = spark.createDataFrame([(0, "booked 2024-12-31 12.50"), (1, "hello world"), (2, "reversal 2025-01-01 99.00"), (3, " "), (4, "")], "i long, text string")
    got = X.ranked_clusters(X.template_clusters(df, "i")).collect()
    assert [(r.signature, r.size, r.first_id) for r in got] == [("<word> <date> <amount>", 2, 0), ("", 2, 3), ("<word> <word>", 1, 1)]


# -- schemas -----------------------------------------------------------------------------------
def kinds(spark, columns, label="cat"):
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return {f.name: f.kind for f in S.infer(df, label).fields}


def test_inference(spark):
    got = kinds(spark, {"amount": ["1", "2.5", " 3"], "city": ["A", "A", "B"], "note": ["x y", "z", "w v"], "cat": ["a", "b", "a"], "none": [None, None, None], "customer": ["KX20417", "LM83305", "EF24680"], "plain": ["ABCDE", "FGHIJ", "KLMNO"], "hex": ["1234f", "12e5", ""]})
    assert got == {"amount": "NUMERIC", "city": "CATEGORICAL", "note": "TEXT", "cat": "LABEL", "none": "TEXT", "customer": "IDENTIFIER", "plain": "TEXT", "hex": "NUMERIC"}
    assert kinds(spark, {"a": ["1"]})["cat"] == "LABEL"
    with pytest.raises(ValueError):
        S.infer(spark.createDataFrame([], "a string"), "a")


@pytest.mark.parametrize("text,ok", [("1f", True), ("1d", True), ("NaN", True), ("nan", False), ("inf", False), ("Infinity", True), ("0x1p3", True), ("1e5", True), (".5", True), ("5.", True), ("", False), ("n/a", False), (" 7 ", True)])
def test_numbers(spark, text, ok):
    assert spark.createDataFrame([(text,)], "x string").select(S.is_numeric(F.col("x"))).first()[0] is ok


def test_validation_and_import(spark):
    schema = S.RecordSchema.define().text("purpose").numeric("amount").label("category").build()
    df = spark.createDataFrame([(1, "Rent", "1200", "housing", None), (2, "Rent", "n/a", "housing", "x"), (3, None, None, " ", None), (4, "r", "", "h", None)], "i int, purpose string, amount string, category string, note string")
    got = {r.i: (r.errors, r.warnings) for r in S.validate(df, schema, ignore=("i",)).collect()}
    assert got[1][0] == [] and got[2][0] == ["'amount' is no number: n/a"]
    assert got[3] == (["label 'category' has no value"], ["'purpose' is not there", "'amount' is not there", "'note' is no field of the schema"])
    assert got[4][0] == ["'amount' is no number: "]
    done = S.import_records(df, schema, keep=("i",))
    assert [r.i for r in done.accepted.collect()] == [1] and sorted(r.i for r in done.rejected.collect()) == [2, 3, 4] and done.warnings.count() == 6
    assert done.accepted.first().feature_text == "Rent 1200"


def test_schema_rules(spark):
    with pytest.raises(ValueError):
        S.RecordSchema.define().text("a").build()
    with pytest.raises(ValueError):
        S.RecordSchema.define().label("a").label("b").build()
    schema = S.RecordSchema.define().text("purpose").identifier("iban").label("c").build()
    df = spark.createDataFrame([(" Rent ", "DE1", None)], "purpose string, iban string, c string")
    r = S.map_records(df, schema).first()
    assert (r.feature_text, r.label) == ("Rent", None)


# -- store -------------------------------------------------------------------------------------
def observations(spark, *rows):
    return spark.createDataFrame(rows, O.OBSERVATIONS)


@pytest.mark.parametrize("encrypted", [False, True])
def test_table_store(spark, tmp_path, encrypted):
    aes = O.AesGcm(bytes(range(32))) if encrypted else None
    s = O.TableStore(spark, f"{tmp_path}/t", aes)
    rows = [(1, "a", [3, 17, 42], [1.0, 2.5, 0.25]), (2, "b", [], []), (3, "a", [3, 17, 42], [1.0, 2.5, 0.25])]
    s.add_all(observations(spark, *rows))
    O.TableStore(spark, f"{tmp_path}/t", aes)
    assert [tuple(r) for r in s.all().orderBy("seq").collect()] == rows and s.size() == 3 and s.labels().count() == 2
    s.clear()
    assert s.size() == 0


def test_memory_store(spark):
    s = O.MemoryStore(spark)
    s.add_all(observations(spark, (1, "a", [1], [1.0]), (2, "b", [1], [1.0]), (3, "a", [1], [1.0])))
    s.add_all(observations(spark, (4, "a", [1], [1.0])))
    assert sorted(r.seq for r in s.all().collect()) == [1, 2]


def test_encryption(spark):
    with pytest.raises(ValueError):
        O.AesGcm(bytes(16))
    aes = O.AesGcm(bytes(range(32)))
    df = spark.createDataFrame([(b"hello",)], "x binary").select(aes.encrypt(F.col("x")).alias("x"))
    sent = bytes(df.first().x)
    assert len(sent) == 12 + 5 + 16
    bad = spark.createDataFrame([(sent[:-1] + bytes([sent[-1] ^ 1]),)], "x binary")
    with pytest.raises(Exception):
        bad.select(aes.decrypt(F.col("x"))).collect()


# -- tagging -----------------------------------------------------------------------------------
def sequence(*words):
    return [(w, "ALPHANUMERIC" if any(c.isdigit() for c in w) else "WORD") for w in words]


def test_crf():
    crf = tagging.Crf()
    for _ in range(200):
        for w, t in (("station", "LATIN"), ("nation", "LATIN"), ("motion", "LATIN"), ("stone", "PLAIN"), ("river", "PLAIN"), ("cloud", "PLAIN")):
            crf.learn(sequence(w), [t])
    assert crf.tag(sequence("ration")) == ["LATIN"]
    with pytest.raises(ValueError):
        crf.learn(sequence("a"), [])
    with pytest.raises(RuntimeError):
        tagging.Crf().tag(sequence("a"))
    crf.learn([], [])
    assert crf.tag([]) == []


def test_crf_in_spark(spark):
    rows = [(k, [{"text": w, "type": t} for w, t in sequence(*ws)], ["KEY", "VALUE"]) for k, ws in enumerate([("customer", "ab12"), ("contract", "xy99"), ("amount", "12")])]
    df = spark.createDataFrame(rows, "seq long, tokens array<struct<text:string,type:string>>, tags array<string>")
    crf = tagging.load_crf(tagging.fit_crf(df, epochs=50, decay=0.001))
    direct = tagging.Crf(decay=0.001)
    for _ in range(50):
        for _, tokens, tags in rows:
            direct.learn([(t["text"], t["type"]) for t in tokens], tags)
    assert crf.tags == direct.tags and abs(crf.state - direct.state).max() < 1e-12 and abs(crf.move - direct.move).max() < 1e-12
    got = df.select(tagging.tag_tokens(F.col("tokens"), crf).alias("t")).collect()
    assert all(r.t == ["KEY", "VALUE"] for r in got)
