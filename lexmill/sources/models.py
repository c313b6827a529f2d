"""Model folders: a manifest and the observations, and the text form of both."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import HashingConfig
from lexmill.operators.schema import Field, RecordSchema

FORMAT, VERSION = "lexmill-model", 1
NAIVE_BAYES, LOGISTIC_REGRESSION = CLASSIFIERS = ("NAIVE_BAYES", "LOGISTIC_REGRESSION")


@dataclass(frozen=True)
class LoadedModel:
    schema: RecordSchema
    classifier: str
    hashing: HashingConfig
    observations: DataFrame


def save_model(path: str, schema: RecordSchema, classifier: str, hashing: HashingConfig, observations: DataFrame) -> None:
    spark = observations.sparkSession
    manifest = {"format": FORMAT, "version": VERSION, "classifier": classifier, "hashing": asdict(hashing), "fields": [asdict(f) for f in schema.fields]}
    observations.select("seq", "label", "indices", "values").write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/observations")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> LoadedModel:
    head = spark.read.text(f"{path}/manifest", wholetext=True).first()
    try:
        m = json.loads(head["value"]) if head else {}
    except ValueError:
        m = {}
    if m.get("format") != FORMAT or m.get("version") != VERSION:
        raise ValueError(f"not a model of version {VERSION}: {path}")
    schema = RecordSchema(tuple(Field(**f) for f in m["fields"]))
    return LoadedModel(schema, m["classifier"], HashingConfig(**m["hashing"]), spark.read.parquet(f"{path}/observations"))


def header_lines(schema: RecordSchema, classifier: str, c: HashingConfig) -> list[str]:
    fields = [f"field {f.kind} {f.name} {f.sensitivity}" for f in schema.fields]
    return [f"{FORMAT} {VERSION}", f"classifier {classifier}", f"hashing {c.key0} {c.key1} {c.num_features} {c.char_min} {c.char_max} {c.word_min} {c.word_max}", *fields, "---"]


def observation_lines(observations: DataFrame) -> DataFrame:
    """``label<TAB>index:value index:value`` in the order of ``seq``."""
    entry = F.transform(F.arrays_zip("indices", "values"), lambda z: F.concat(z["indices"].cast("string"), F.lit(":"), z["values"].cast("string")))
    return observations.select("seq", F.concat(F.col("label"), F.lit("\t"), F.array_join(entry, " ")).alias("value"))


def export_text(model: LoadedModel, path: str) -> None:
    """The whole model as text files, header first."""
    spark = model.observations.sparkSession
    head = spark.createDataFrame([(-1, k, v) for k, v in enumerate(header_lines(model.schema, model.classifier, model.hashing))], "part int, seq long, value string")
    body = observation_lines(model.observations).select(F.lit(0).alias("part"), "seq", "value")
    head.unionByName(body).repartitionByRange("part", "seq").sortWithinPartitions("part", "seq").select("value").write.mode("overwrite").text(path)
