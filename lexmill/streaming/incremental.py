"""Streams of records.

Classifying a stream is the batch transformation: it keeps no state.  Learning from a stream appends each micro-batch's statistics
to tables under its batch number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexmill.operators.classifiers import NaiveBayesModel, fit_naive_bayes
from lexmill.plans.engine import Engine


def classify_stream(engine: Engine, records: DataFrame) -> DataFrame:
    return engine.classify(records)


def _write(batch: DataFrame, number: int, engine: Engine, path: str) -> None:
    rows = engine.vectorized(batch).filter("label is not null").persist()
    model = fit_naive_bayes(rows)
    model.counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels/batch={number}")
    rows.unpersist()


def learn_stream(engine: Engine, records: DataFrame, path: str) -> DataStreamWriter:
    """A writer that learns from labelled records; start it with a checkpoint location."""
    return records.writeStream.foreachBatch(lambda df, n: _write(df, n, engine, path))


def streamed_model(spark: SparkSession, path: str, alpha: float = 1.0) -> NaiveBayesModel:
    """The model of all batches so far."""
    counts = spark.read.parquet(f"{path}/counts").groupBy("label", "idx").agg(F.sum("total").alias("total"))
    labels = spark.read.parquet(f"{path}/labels").groupBy("label").agg(F.sum("docs").alias("docs"), F.sum("mass").alias("mass"))
    return NaiveBayesModel(counts, labels, None, alpha)
