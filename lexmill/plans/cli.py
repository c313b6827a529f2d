"""Command line: label, predict, export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import HashingConfig
from lexmill.operators import classifiers as C
from lexmill.operators.schema import infer
from lexmill.plans.engine import Engine
from lexmill.plans.labeling import Session, parse_reply
from lexmill.sources.csv import read_records, write_records
from lexmill.sources.models import LOGISTIC_REGRESSION, NAIVE_BAYES, export_text, load_model

_KINDS = {"nb": NAIVE_BAYES, "logreg": LOGISTIC_REGRESSION}
_STRATEGIES = {"margin": C.MARGIN, "least-confidence": C.LEAST_CONFIDENCE, "entropy": C.ENTROPY}


def _key(text: str) -> tuple[int, int]:
    a, b = text.split(",")
    return int(a), int(b)


def _delimiter(text: str) -> str:
    text = "\t" if text == "\\t" else text
    if len(text) != 1:
        raise argparse.ArgumentTypeError("one character")
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name, allow_abbrev=False)
    label, predict, export = add("label"), add("predict"), add("export")
    for p in (label, predict):
        p.add_argument("--input", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--epochs", type=int, default=5)
        p.add_argument("--delimiter", type=_delimiter, default=",")
    label.add_argument("--label-col", required=True)
    label.add_argument("--model")
    label.add_argument("--classifier", choices=_KINDS, default="nb")
    label.add_argument("--budget", type=int, default=20)
    label.add_argument("--batch", type=int, default=8)
    label.add_argument("--strategy", choices=_STRATEGIES, default="margin")
    label.add_argument("--key", type=_key)
    label.add_argument("--scan-limit", type=int, default=0)
    predict.add_argument("--model", required=True)
    export.add_argument("--model", required=True)
    export.add_argument("--out", required=True)
    return top


def predict_frame(engine: Engine, records: DataFrame) -> DataFrame:
    """The label column is overwritten; confidence is text with four decimals."""
    name = engine.schema.label.name
    scored = engine.classify(records, "__p")
    return scored.withColumn(name, F.col("__p.label")).withColumn("confidence", F.format_string("%.4f", F.col("__p.confidence"))).drop("__p")


def _exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _ask(row, prediction) -> str:
    shown = {k: v for k, v in row.asDict().items() if k not in ("row_id", "prediction", "margin", "uncertainty")}
    guess = "" if prediction is None else " ".join(f"{a['label']} {a['probability']:.2f}" for a in prediction["alternatives"][:3])
    print(shown, guess, sep="\n")
    return parse_reply(input("label [Enter = accept, s = skip, q = quit]: "))


def main(args: list[str] | None = None, spark: SparkSession | None = None, ask=_ask) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lexmill").getOrCreate()
    if a.command == "export":
        export_text(load_model(spark, a.model), a.out)
        return 0
    records = read_records(spark, a.input, a.delimiter)
    columns = [c for c in records.columns if c != "row_id"]
    if a.command == "predict":
        engine = Engine.load(spark, a.model, a.epochs)
        done = predict_frame(engine, records)
        header = [*columns, *[c for c in (engine.schema.label.name, "confidence") if c not in columns]]
    else:
        if a.label_col not in columns:
            records, columns = records.withColumn(a.label_col, F.lit("")), [*columns, a.label_col]
        if _exists(spark, a.model):
            engine = Engine.load(spark, a.model, a.epochs)
        else:
            hashing = HashingConfig(*a.key) if a.key else HashingConfig.random_key()
            engine = Engine(spark, infer(records.drop("row_id"), a.label_col), hashing, _KINDS[a.classifier])
        done = Session(engine, ask, a.budget, a.batch, _STRATEGIES[a.strategy], a.epochs, a.scan_limit).run(records)
        header = columns
        if a.model:
            engine.save(a.model)
    write_records(done.orderBy("row_id"), a.out, header, a.delimiter)
    return 0


if __name__ == "__main__":
    sys.exit(main())
