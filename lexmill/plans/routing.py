"""Classify, route, extract: the slots depend on the predicted label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import GERMAN, TokenRules, tokenize
from lexmill.operators.extraction import FIELD, Slot, extract


def route(label: Column, tokens: Column, slots: dict[str, list[Slot]]) -> Column:
    """Fields of the slots of a row's label; no fields for other labels."""
    out = F.array().cast(f"array<{FIELD}>")
    for name, own in slots.items():
        mine = F.when(label == name, tokens)  # null elsewhere, so that other rows aren't searched
        out = F.when(label == name, extract(mine, own)).otherwise(out)
    return out


def extract_by_label(df: DataFrame, label: Column, text_col: str, slots: dict[str, list[Slot]], rules: TokenRules = GERMAN) -> DataFrame:
    """Adds ``fields``.  Tokens are made once and dropped again."""
    return df.withColumn("__tokens", tokenize(F.col(text_col), rules)).withColumn("fields", route(label, F.col("__tokens"), slots)).drop("__tokens")
