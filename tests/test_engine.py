import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.hashing import HashingConfig
from lexmill.operators import classifiers as C
from lexmill.operators import schema as S
from lexmill.operators.store import OBSERVATIONS
from lexmill.plans import cli, labeling, logwatch
from lexmill.plans.engine import Engine
from lexmill.sources import csv, models
from lexmill.sources.logs import read_log, write_findings

SCHEMA = S.RecordSchema.define().text("purpose").identifier("iban").label("category").build()
ROWS = [("green tea and kettle", "K1", "kitchen"), ("kettle with lid", "K2", "kitchen"), ("spade and garden hose", "G1", "garden"), ("hose reel", "G2", "garden")]
KEY = HashingConfig(1, 2)


def records(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_id long, purpose string, iban string, category string")


def predict(engine, spark, text):
    return engine.classify(records(spark, [(text, None, None)])).first().prediction


def vectors(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], OBSERVATIONS)


OBS = [("spam", [1, 2], [1.0, 2.0]), ("ham", [2, 3], [1.0, 1.0]), ("spam", [1], [3.0]), ("ham", [5], [2.0]), ("eggs", [], [])]


def slow_bayes(rows, x):
    labels = sorted({r[0] for r in rows})
    seen = {i for r in rows for i in r[1]}
    out = {}
    for name in labels:
        own = [r for r in rows if r[0] == name]
        count = {}
        for _, i, v in own:
            for a, b in zip(i, v):
                count[a] = count.get(a, 0) + b
        m = sum(count.values())
        out[name] = math.log(len(own) / len(rows)) + sum(b * math.log((count.get(a, 0) + 1) / (m + max(1, len(seen)))) for a, b in zip(*x))
    top = max(out.values())
    z = sum(math.exp(s - top) for s in out.values())
    return {n: math.exp(s - top) / z for n, s in out.items()}


@pytest.mark.parametrize("incremental", [False, True])
def test_naive_bayes(spark, incremental):
    model = C.fit_naive_bayes(vectors(spark, OBS[:2])) if incremental else C.fit_naive_bayes(vectors(spark, OBS))
    if incremental:
        model = C.add_naive_bayes(model, vectors(spark, OBS[2:]))
    asked = [([1, 3], [1.0, 2.0]), ([], []), ([9], [4.0]), ([2], [1.0])]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "row_id long, indices array<int>, values array<float>")
    dense = {r.row_id: r.prediction for r in C.score_dense(df, C.naive_bayes_weights(model)).collect()}
    joined = {r.row_id: r.prediction for r in C.score_joined(df, model).collect()}
    for k, x in enumerate(asked):
        want = slow_bayes(OBS, x)
        for got in (dense[k], joined[k]):
            p = {a["label"]: a["probability"] for a in got["alternatives"]}
            assert abs(sum(p.values()) - 1) < 1e-9
            assert all(abs(p[n] - want[n]) < 1e-9 for n in want)
            assert got["label"] == got["alternatives"][0]["label"] and got["confidence"] == got["alternatives"][0]["probability"]


def test_batch_replaces_but_vocabulary_grows(spark):
    first = C.fit_naive_bayes(vectors(spark, OBS[:2]))
    second = C.fit_naive_bayes(vectors(spark, OBS[3:4]), seen=first.features)
    assert second.vocabulary == 4 and [r.label for r in second.labels.collect()] == ["ham"]


def test_logistic(spark):
    rows = [("a", [1], [1.0]), ("b", [2], [1.0])]
    table = C.fit_logistic(vectors(spark, rows), epochs=50)
    t = C.SgdTrainer()
    for _ in range(50):
        for r in rows:
            t.learn(*r)
    got = C.logistic_weights(table)
    assert np.allclose(got.bias, t.model().bias) and all(np.allclose(a[1], b[1]) for a, b in zip(got.weights, t.model().weights))
    df = spark.createDataFrame([(0, [1], [1.0])], "row_id long, indices array<int>, values array<float>")
    assert C.score_dense(df, got).first().prediction["label"] == "a"
    assert C.rank(C.linear_scores(df, table)).first().prediction["label"] == "a"
    shuffled = [C.fit_logistic(vectors(spark, OBS), 3, seed=42).orderBy("label", "idx").collect() for _ in range(2)]
    assert shuffled[0] == shuffled[1]
    slow = C.fit_logistic(vectors(spark, rows), 50, decay=1.0)
    assert abs(C.logistic_weights(slow).weights[0][1]).max() < abs(got.weights[0][1]).max()
    with pytest.raises(ValueError):
        C.fit_logistic(vectors(spark, rows), 0)
    with pytest.raises(C.NotTrained):
        C.linear_model({}, {})


def test_engine(spark):
    engine = Engine(spark, SCHEMA, KEY)
    with pytest.raises(C.NotTrained):
        engine.classify(records(spark, ROWS))
    engine.learn(records(spark, ROWS))
    assert predict(engine, spark, "kettle for tea")["label"] == "kitchen"
    assert {r.label: r.observations for r in engine.metrics().collect()} == {"garden": 2, "kitchen": 2}
    with pytest.raises(ValueError):
        engine.learn(records(spark, [("x", None, " ")]))
    before = predict(engine, spark, "zoo visit")["label"]
    for _ in range(3):
        engine.feedback(records(spark, [("zoo visit", None, None)]), "leisure")
    assert predict(engine, spark, "zoo visit")["label"] == "leisure" != before
    assert engine.store.size() == 5
    engine.retrain()
    engine.forget()
    assert not engine.is_trained and engine.store.size() == 0


def test_logistic_engine(spark):
    engine = Engine(spark, SCHEMA, KEY, models.LOGISTIC_REGRESSION)
    engine.learn(records(spark, ROWS))
    engine.retrain(80, seed=42)
    assert predict(engine, spark, "tea kettle")["label"] == "kitchen"
    with pytest.raises(ValueError):
        engine.retrain(0)


@pytest.mark.parametrize("strategy", C.STRATEGIES)
def test_review(spark, strategy):
    engine = Engine(spark, SCHEMA, KEY)
    engine.learn(records(spark, ROWS))
    pool = records(spark, [("green tea and kettle", None, None), ("qq vv ww", None, None)])
    got = engine.select_for_review(pool, 2, strategy).collect()
    assert [r.purpose for r in got][0] == "qq vv ww" and got[0].margin < got[1].margin
    with pytest.raises(ValueError):
        engine.select_for_review(pool, -1, strategy)
    one = Engine(spark, SCHEMA, KEY)
    one.learn(records(spark, ROWS[:2]))
    assert one.select_for_review(pool, 1).first().margin == 1.0


@pytest.mark.parametrize("kind", models.CLASSIFIERS)
def test_save_and_load(spark, tmp_path, kind):
    engine = Engine(spark, SCHEMA, KEY, kind)
    engine.learn(records(spark, ROWS))
    engine.save(f"{tmp_path}/m")
    back = Engine.load(spark, f"{tmp_path}/m")
    assert back.schema == SCHEMA and back.hashing == KEY and back.classifier == kind
    a, b = predict(engine, spark, "kettle"), predict(back, spark, "kettle")
    assert a["label"] == b["label"] and abs(a["confidence"] - b["confidence"]) < 1e-9
    models.export_text(models.load_model(spark, f"{tmp_path}/m"), f"{tmp_path}/x")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/x").collect()]
    assert "---" in lines and len(lines) == 3 + 3 + 1 + 4
    spark.createDataFrame([(json.dumps({"format": "other"}),)], "value string").write.text(f"{tmp_path}/bad/manifest")
    with pytest.raises(ValueError):
        models.load_model(spark, f"{tmp_path}/bad")


def test_csv(spark, tmp_path):
    assert csv.parse('a,b\r\n"x, ""y""",2\n\nq"u,o"te,"line\nbreak"') == [["a", "b"], ['x, "y"', "2"], [""], ["qu,ote", "line\nbreak"]]
    assert csv.parse(csv.BOM + "a\tb\n", "\t") == [["a", "b"]] and csv.parse("") == []
    assert csv.records("a,b,a\n1\n1,2,3,4\n") == (["a", "b", "a"], [{"a": "", "b": ""}, {"a": "3", "b": "2"}])
    assert csv.format_row(["a", 'b"', "c,d", "e\nf"]) == 'a,"b""","c,d","e\nf"'
    (tmp_path / "in.csv").write_text('purpose,category\n"rent, flat",housing\nshort\n')
    df = csv.read_records(spark, f"{tmp_path}/in.csv")
    assert [(r.purpose, r.category) for r in df.orderBy("row_id").collect()] == [("rent, flat", "housing"), ("short", "")]
    csv.write_records(df.orderBy("row_id"), f"{tmp_path}/out", ["purpose", "new", "category"], single=True)
    text = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_text()
    assert text == 'purpose,new,category\n"rent, flat",,housing\nshort,,\n'
    strict = csv.read_records_strict(spark, f"{tmp_path}/in.csv", ["purpose", "category"]).collect()
    assert [(r.row, r.purpose, r.category) for r in strict] == [(0, "rent, flat", "housing"), (1, "short", "")]


TRANSACTIONS = [("car insurance premium", "insurance"), ("liability insurance", "insurance"), ("apartment rent", "rent"), ("garage rent", "rent"), ("insurance for house", ""), ("monthly rent", ""), ("unknown thing", "")]


def test_labelling(spark):
    schema = S.RecordSchema.define().text("purpose").label("category").build()
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(TRANSACTIONS)], "row_id long, purpose string, category string")
    asked = []

    def ask(row, prediction):
        asked.append(row.purpose)
        return {"unknown thing": "other", "monthly rent": labeling.ACCEPT}.get(row.purpose, labeling.SKIP)

    engine = Engine(spark, schema, KEY)
    got = {r.purpose: r.category for r in labeling.Session(engine, ask, budget=5, batch=2).run(df).collect()}
    assert got["unknown thing"] == "other" and got["monthly rent"] == "rent" and got["insurance for house"] == ""
    assert sorted(asked) == ["insurance for house", "monthly rent", "unknown thing"] and "other" in engine.labels()
    quit_ = labeling.Session(Engine(spark, schema, KEY), lambda r, p: labeling.QUIT).run(df)
    assert quit_.filter("category = ''").count() == 3
    assert [labeling.parse_reply(x) for x in ("", "y", "s", "q", " tax ")] == [labeling.ACCEPT, labeling.ACCEPT, labeling.SKIP, labeling.QUIT, "tax"]


def test_commands(spark, tmp_path):
    (tmp_path / "in.csv").write_text("purpose,category\n" + "".join(f"{p},{c}\n" for p, c in TRANSACTIONS))
    ask = lambda row, prediction: labeling.ACCEPT
    assert cli.main(["label", "--input", f"{tmp_path}/in.csv", "--label-col", "category", "--out", f"{tmp_path}/out", "--model", f"{tmp_path}/m", "--key", "1,2", "--budget", "3"], spark, ask) == 0
    assert all(r.category for r in csv.read_records(spark, f"{tmp_path}/out").collect())
    assert cli.main(["predict", "--input", f"{tmp_path}/in.csv", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/p"], spark) == 0
    got = csv.read_records(spark, f"{tmp_path}/p").collect()
    assert {r.category for r in got} <= {"insurance", "rent"} and all(len(r.confidence.split(".")[1]) == 4 for r in got)
    assert cli.main(["export", "--model", f"{tmp_path}/m", "--out", f"{tmp_path}/e"], spark) == 0
    for bad in (["label"], ["predict", "--input", "x", "--out", "y", "--model", "m", "--nonsense", "1"], ["predict", "--inp", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_log_watch(spark, tmp_path):
    rules = spark.createDataFrame([("DB_ERROR", "ERROR", "connection to database failed"), ("NORMAL", "INFO", "started"), ("TIMEOUT", "WARN", "request timed out"), ("NORMAL", "INFO", "request served")], "anomaly_type string, level string, message string")
    (tmp_path / "a.log").write_text("2024-01-01 10:00:00.000 ERROR db - connection to database failed\n\n2024 INFO x - request served\nno level here\n[WARN] y - request timed out - twice\nINFO then ERROR plain\n")
    engine = logwatch.train(spark, rules, KEY)
    got = logwatch.scan(engine, read_log(spark, f"{tmp_path}/a.log"))
    assert sorted((r.level, r.anomaly_type) for r in got.collect())[0] == ("ERROR", "DB_ERROR") and got.count() == 4
    found = logwatch.findings(got, 0.3)
    assert "NORMAL" not in {r.anomaly_type for r in found.collect()}
    write_findings(found, f"{tmp_path}/f")
    assert spark.read.csv(f"{tmp_path}/f", header=True).columns == ["level", "anomaly_type", "confidence", "log_line"]


def test_stream(spark, tmp_path):
    from lexmill.streaming.incremental import classify_stream, learn_stream, streamed_model

    engine = Engine(spark, SCHEMA, KEY)
    df = records(spark, ROWS)
    for k in range(2):
        df.filter(F.col("row_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = learn_stream(engine, stream, f"{tmp_path}/model").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    engine.learn(df)
    want = C.fit_naive_bayes(engine.vectorized(df))
    got = streamed_model(spark, f"{tmp_path}/model")
    key = lambda m: sorted(map(tuple, m.counts.collect()))
    assert key(got) == key(want)
    q = classify_stream(engine, stream).select("row_id", "prediction.label").writeStream.format("memory").queryName("labelled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("labelled").count() == 4


def test_privacy(spark):
    with pytest.raises(ValueError):
        Engine(spark, SCHEMA, KEY, privacy="ENCRYPTED_SOURCE")
    with pytest.raises(ValueError):
        Engine(spark, SCHEMA, KEY).sources()
    engine = Engine(spark, SCHEMA, KEY, privacy="ENCRYPTED_SOURCE", source_key=bytes(range(32)))
    assert engine.sources().count() == 0
    engine.learn(records(spark, ROWS))
    assert sorted(r.text for r in engine.open_sources().collect()) == sorted(r[0] for r in ROWS)
    assert not any(b"rent" in bytes(r.source) for r in engine.sources().collect())


def test_records_of_different_shapes(spark):
    df = spark.createDataFrame([(1, {"purpose": "rent", "category": "h"}), (2, {"purpose": "x", "note": "n", "category": "h"}), (3, {})], "i int, m map<string,string>")
    got = {r.i: (r.errors, r.warnings) for r in S.validate(S.from_maps(df, "m", SCHEMA, keep=("i",)), SCHEMA, ignore=("i",), unknown_col="unknown_fields").collect()}
    assert got[1] == ([], ["'iban' is not there"])
    assert got[2][1] == ["'iban' is not there", "'note' is no field of the schema"]
    assert got[3][0] == ["label 'category' has no value"]
