"""Anomaly search in logs: learn from rules, classify lines, keep findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import HashingConfig
from lexmill.operators.schema import RecordSchema
from lexmill.plans.engine import Engine
from lexmill.sources.logs import parse_lines

NORMAL = "NORMAL"
SCHEMA = RecordSchema.define().label("anomaly_type").categorical("level").text("message").build()


def train(spark: SparkSession, rules: DataFrame, hashing: HashingConfig) -> Engine:
    """``rules``: anomaly_type, level, message."""
    engine = Engine(spark, SCHEMA, hashing)
    engine.learn(rules)
    return engine


def scan(engine: Engine, lines: DataFrame, col: str = "value") -> DataFrame:
    """level, anomaly_type, confidence, log_line and other columns of every line that has a level."""
    scored = engine.classify(parse_lines(lines, col))
    return scored.withColumns({"anomaly_type": F.col("prediction.label"), "confidence": F.col("prediction.confidence"), "log_line": F.col(col)}).drop("prediction", "message")


def findings(scanned: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return scanned.filter((F.col("anomaly_type") != NORMAL) & (F.col("confidence") >= min_confidence))
