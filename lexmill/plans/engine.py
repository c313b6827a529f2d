"""A classification engine: one schema, one model, one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import HashingConfig, vectorize
from lexmill.functions.text import normalize
from lexmill.operators import classifiers as C
from lexmill.operators.schema import RecordSchema, feature_text, label_of
from lexmill.operators.store import AesGcm, FeatureStore, MemoryStore
from lexmill.sources.models import CLASSIFIERS, LOGISTIC_REGRESSION, NAIVE_BAYES, LoadedModel, load_model, save_model

FEATURES_ONLY, ENCRYPTED_SOURCE = PRIVACY_MODES = ("FEATURES_ONLY", "ENCRYPTED_SOURCE")


class Engine:
    """Learning counts every observation; the store may drop repeated ones, so ``retrain`` can differ from the live model."""

    def __init__(self, spark: SparkSession, schema: RecordSchema, hashing: HashingConfig, classifier: str = NAIVE_BAYES, store: FeatureStore | None = None, privacy: str = FEATURES_ONLY, normalizer=normalize, rate: float = 0.1, decay: float = 0.0, l2: float = 0.0, source_key: bytes | None = None):
        if classifier not in CLASSIFIERS or privacy not in PRIVACY_MODES:
            raise ValueError("unknown classifier or privacy mode")
        if privacy == ENCRYPTED_SOURCE and source_key is None:
            raise ValueError("ENCRYPTED_SOURCE needs a key")
        self._aes = AesGcm(source_key) if privacy == ENCRYPTED_SOURCE else None
        self._sources: DataFrame | None = None
        self.spark, self.schema, self.hashing, self.classifier, self.privacy, self.normalizer = spark, schema, hashing, classifier, privacy, normalizer
        self.store = store if store is not None else MemoryStore(spark)
        self.sgd = {"rate": rate, "decay": decay, "l2": l2}
        self._seq = 0
        self._bayes: C.NaiveBayesModel | None = None
        self._linear: C.LinearModel | None = None
        self._learned: DataFrame | None = None

    # -- features ------------------------------------------------------------------------------
    def vectorized(self, records: DataFrame, *keep: str) -> DataFrame:
        """``keep``, label, indices, values."""
        text = records.select(*keep, label_of(records, self.schema).alias("label"), feature_text(records, self.schema).alias("__text"))
        v = vectorize(F.col("__text"), self.hashing, self.normalizer)
        return text.select(*keep, "label", v.alias("__v")).select(*keep, "label", F.col("__v.indices").alias("indices"), F.col("__v.values").alias("values"))

    def _observations(self, records: DataFrame, label: str | None) -> DataFrame:
        rows = self.vectorized(records)
        if label is not None:
            rows = rows.withColumn("label", F.lit(label))
        base = self._seq
        return rows.select((F.monotonically_increasing_id() + base).alias("seq"), "label", "indices", "values")

    # -- learning ------------------------------------------------------------------------------
    def learn(self, records: DataFrame, label: str | None = None) -> None:
        """Adds records to the model and the store.  All of them need a label; nothing is learned if one has none."""
        new = self._observations(records, label).persist()
        counted = new.agg(F.count(F.lit(1)), F.count("label"), F.max("seq")).first()
        if counted[0] != counted[1]:
            new.unpersist()
            raise ValueError("a record has no label")
        if not counted[0]:
            return
        if self._aes is not None:
            text = records.select((F.monotonically_increasing_id() + self._seq).alias("seq"), self._aes.encrypt(feature_text(records, self.schema).cast("binary")).alias("source")).persist()
            self._sources = text if self._sources is None else self._sources.unionByName(text)
        self._seq = counted[2] + 1
        self.store.add_all(new)
        if self.classifier == NAIVE_BAYES:
            self._bayes = C.fit_naive_bayes(new) if self._bayes is None else C.add_naive_bayes(self._bayes, new)
            self._linear = None
        else:
            self._learned = new if self._learned is None else self._learned.unionByName(new)
            self._linear = C.logistic_weights(C.fit_logistic(self._learned, **self.sgd))

    def feedback(self, records: DataFrame, label: str) -> None:
        """Learns records under the label that is right."""
        self.learn(records, label)

    def retrain(self, epochs: int = 1, seed: int | None = None) -> None:
        """A model from scratch from the store."""
        if epochs < 1:
            raise ValueError("training needs an epoch or more")
        rows = self.store.all()
        if self.classifier == NAIVE_BAYES:
            self._bayes, self._linear = C.fit_naive_bayes(rows), None
        else:
            self._learned = rows
            self._linear = C.logistic_weights(C.fit_logistic(rows, epochs, seed, **self.sgd)) if not rows.isEmpty() else None

    def sources(self) -> DataFrame:
        """(seq, source): the encrypted public text of what was learned; only in the ENCRYPTED_SOURCE mode."""
        if self._aes is None:
            raise ValueError("this engine keeps no sources")
        return self._sources if self._sources is not None else self.spark.createDataFrame([], "seq long, source binary")

    def open_sources(self) -> DataFrame:
        """(seq, text), decrypted."""
        return self.sources().select("seq", self._aes.decrypt(F.col("source")).cast("string").alias("text"))

    def forget(self) -> None:
        self._bayes = self._linear = self._learned = self._sources = None
        self.store.clear()

    @property
    def is_trained(self) -> bool:
        return self._bayes is not None and not self._bayes.labels.isEmpty() or self._linear is not None

    # -- using it ------------------------------------------------------------------------------
    def weights(self) -> C.LinearModel:
        if self._linear is None:
            if self._bayes is None:
                raise C.NotTrained("the classifier has not been trained")
            self._linear = C.naive_bayes_weights(self._bayes)
        return self._linear

    def labels(self) -> tuple[str, ...]:
        return self.weights().labels if self.is_trained else ()

    def classify(self, records: DataFrame, out: str = "prediction") -> DataFrame:
        """The records with a prediction: winner, confidence, all labels ranked.  One pass, no shuffle."""
        v = vectorize(feature_text(records, self.schema), self.hashing, self.normalizer)
        rows = records.withColumn("__v", v).withColumns({"indices": F.col("__v.indices"), "values": F.col("__v.values")})
        return C.score_dense(rows, self.weights(), out).drop("__v", "indices", "values")

    def metrics(self) -> DataFrame:
        return C.metrics(self.store.all())

    def select_for_review(self, records: DataFrame, limit: int, strategy: str = C.MARGIN, key: str = "row_id") -> DataFrame:
        return C.select_for_review(self.classify(records), limit, strategy, key)

    # -- saving --------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        save_model(path, self.schema, self.classifier, self.hashing, self.store.all())

    @classmethod
    def from_model(cls, spark: SparkSession, model: LoadedModel, epochs: int = 1, **more) -> Engine:
        """Replays the observations of a saved model; Naive Bayes needs one pass, whatever ``epochs`` says."""
        engine = cls(spark, model.schema, model.hashing, model.classifier, **more)
        engine.store.add_all(model.observations)
        top = model.observations.agg(F.max("seq")).first()[0]
        engine._seq = 0 if top is None else top + 1
        engine.retrain(epochs if model.classifier == LOGISTIC_REGRESSION else 1)
        return engine

    @classmethod
    def load(cls, spark: SparkSession, path: str, epochs: int = 1, **more) -> Engine:
        return cls.from_model(spark, load_model(spark, path), epochs, **more)
