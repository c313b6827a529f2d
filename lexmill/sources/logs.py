"""Log lines: reading, parsing, writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import trim_space

#: Levels in the order in which they are looked for.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def level_of(line: Column) -> Column:
    """The first level of the list that is a token of the line; null if none is."""
    tokens = F.split(F.upper(line), r"[\s\[\]:|]+")
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(F.array_contains(tokens, x), F.lit(x)) for x in LEVELS])


def message_of(line: Column) -> Column:
    """What follows the first " - ", else the whole line; trimmed."""
    at = F.locate(" - ", line)
    return trim_space(F.when(at > 0, line.substr(at + 3, F.length(line))).otherwise(line))


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Adds level and message; lines without a level are dropped."""
    return lines.withColumn("level", level_of(F.col(col))).withColumn("message", message_of(F.col(col))).filter("level is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a log."""
    return spark.read.text(path).filter(F.col("value").rlike(r"[^\s\p{Z}]"))


def read_rules(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A naive rules file: split at the first commas only, cells trimmed."""
    cells = F.split("value", ",", len(header))
    rows = spark.read.text(path).filter(F.trim("value") != "").filter(F.col("value") != ",".join(header))
    return rows.select(*[trim_space(F.get(cells, F.lit(k))).alias(h) for k, h in enumerate(header)])


def write_findings(df: DataFrame, path: str) -> None:
    """level, anomaly_type, confidence, log_line."""
    df.select("level", "anomaly_type", F.format_string("%.4f", "confidence").alias("confidence"), "log_line").write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
