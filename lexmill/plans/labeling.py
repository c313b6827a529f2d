"""Active-learning sessions: the driver asks, the cluster scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexmill.operators import classifiers as C
from lexmill.operators.schema import label_of
from lexmill.plans.engine import Engine

ACCEPT, SKIP, QUIT = "accept", "skip", "quit"
#: Given a row with its prediction (none while there is no model): ACCEPT, SKIP, QUIT, or a label.
Oracle = Callable[[Row, object], str]


def parse_reply(text: str) -> str:
    """What a person types: Enter or y accepts, s skips, q quits, anything else is a label."""
    t = text.strip()
    return ACCEPT if t.lower() in ("", "y") else SKIP if t.lower() == "s" else QUIT if t.lower() == "q" else t


@dataclass
class Session:
    engine: Engine
    ask: Oracle
    budget: int = 20
    batch: int = 8
    strategy: str = C.MARGIN
    epochs: int = 5
    scan_limit: int = 0
    key: str = "row_id"

    def run(self, records: DataFrame) -> DataFrame:
        """The records with the labels that were given.  Labelled rows train an engine that is untrained; a resumed one
        has learned them.  Within a batch predictions aren't renewed."""
        spark, schema, name = records.sparkSession, self.engine.schema, self.engine.schema.label.name
        records = records.persist()
        have = label_of(records, schema).isNotNull()
        labelled = records.filter(have)
        if not self.engine.is_trained and not labelled.isEmpty():
            self.engine.learn(labelled)
            if self.engine.classifier == C_LOGISTIC and self.epochs > 1:
                self.engine.retrain(self.epochs)
        given: dict[object, str] = {}
        seen: set[object] = set()
        stop = False
        while not stop and len(given) < self.budget:
            pool = records.filter(~have)
            if seen:
                pool = pool.join(F.broadcast(spark.createDataFrame([(s,) for s in seen], pool.select(self.key).schema)), self.key, "left_anti")
            n = min(self.batch, self.budget - len(given))
            pool = C.sample_pool(pool, self.scan_limit, n, seed=len(seen), key=self.key)
            chosen = (self.engine.select_for_review(pool, n, self.strategy, self.key) if self.engine.is_trained else pool.orderBy(self.key).limit(n)).collect()
            if not chosen:
                break
            taught: dict[str, list[object]] = {}
            for row in chosen:
                seen.add(row[self.key])
                prediction = row["prediction"] if "prediction" in row else None
                reply = self.ask(row, prediction)
                if reply == QUIT:
                    stop = True
                    break
                if reply == SKIP or (reply == ACCEPT and prediction is None):
                    continue
                label = prediction["label"] if reply == ACCEPT else reply
                given[row[self.key]] = label
                taught.setdefault(label, []).append(row[self.key])
            for label, keys in taught.items():
                self.engine.feedback(records.filter(F.col(self.key).isin(keys)), label)
        if not given:
            return records
        new = spark.createDataFrame(list(given.items()), f"`{self.key}` {dict(records.dtypes)[self.key]}, __label string")
        merged = records.join(F.broadcast(new), self.key, "left")  # at most ``budget`` rows
        return merged.withColumn(name, F.coalesce("__label", F.col(name))).select(*records.columns)


C_LOGISTIC = "LOGISTIC_REGRESSION"
