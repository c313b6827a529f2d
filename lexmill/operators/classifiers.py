"""Naive Bayes and logistic regression over sparse vectors, and ranked predictions.

Naive Bayes trains by aggregation.  Scoring has two forms with the same results: ``score_dense`` hands a weight matrix whose
size is checked to an Arrow UDF and shuffles nothing; ``score_joined`` joins exploded features
with the model table and suits models that are too large for that.
Logistic regression by SGD depends on the order of its observations; it trains in one task, sorted by ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREDICTION = "struct<label:string,confidence:double,alternatives:array<struct<label:string,probability:double>>>"
#: Most bytes of a weight matrix that is handed to the executors.
DENSE_BYTES = 512 << 20


class NotTrained(RuntimeError):
    pass


@dataclass(frozen=True)
class NaiveBayesModel:
    """Sufficient statistics as tables: counts (label, idx, total), labels (label, docs, mass), seen (idx; None if only
    the features in counts were ever seen), docs (label, docs; what of labels needs no features, None if it has no plan of its own)."""

    counts: DataFrame
    labels: DataFrame
    seen: DataFrame | None = None
    alpha: float = 1.0
    docs: DataFrame | None = None

    @property
    def features(self) -> DataFrame:
        return self.counts.select("idx").distinct() if self.seen is None else self.seen

    @property
    def vocabulary(self) -> int:
        return max(1, self.features.count())

    def label_names(self) -> list[str]:
        return sorted(r["label"] for r in self.labels.select("label").collect())


def explode_features(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.arrays_zip("indices", "values")).alias("f")).select(*keep, F.col("f.indices").alias("idx"), F.col("f.values").cast("double").alias("v"))


def fit_naive_bayes(observations: DataFrame, alpha: float = 1.0, seen: DataFrame | None = None) -> NaiveBayesModel:
    """A model from scratch.  ``observations``: (label, indices, values).  ``seen`` are features of earlier batches, which still
    count for the size of the vocabulary after a batch replaced the counts."""
    each = explode_features(observations, "label")
    counts = each.groupBy("label", "idx").agg(F.sum("v").alias("total"))
    docs = observations.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    mass = counts.groupBy("label").agg(F.sum("total").alias("mass"))
    labels = docs.join(mass, "label", "left").select("label", "docs", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    return NaiveBayesModel(counts, labels, None if seen is None else counts.select("idx").union(seen).distinct(), alpha, docs)


def add_naive_bayes(model: NaiveBayesModel, observations: DataFrame) -> NaiveBayesModel:
    """Incremental learning: sums of the statistics."""
    new = fit_naive_bayes(observations, model.alpha)
    counts = model.counts.unionByName(new.counts).groupBy("label", "idx").agg(F.sum("total").alias("total"))
    labels = model.labels.unionByName(new.labels).groupBy("label").agg(F.sum("docs").alias("docs"), F.sum("mass").alias("mass"))
    return NaiveBayesModel(counts, labels, None if model.seen is None else model.seen.union(counts.select("idx")).distinct(), model.alpha)


@dataclass(frozen=True)
class LinearModel:
    """Log score of a label: ``bias + total * rest + sum(v * weight[idx])`` (``total``: sum of a vector's values)."""

    labels: tuple[str, ...]
    bias: np.ndarray
    rest: np.ndarray
    weights: tuple[tuple[np.ndarray, np.ndarray], ...]  # per label: sorted idx, weight


def naive_bayes_weights(model: NaiveBayesModel, dense_bytes: int = DENSE_BYTES) -> LinearModel:
    """Weights for the driver; refuses a model that is larger than ``dense_bytes``."""
    rows = dense_bytes // 24
    got = model.counts.limit(rows + 1).toArrow()  # the only pass over the observations' features: the masses are sums of these
    if got.num_rows > rows:
        raise MemoryError("the model is too large to be broadcast; use score_joined")
    labels = sorted((model.labels if model.docs is None else model.docs).collect(), key=lambda r: r["label"])
    if not labels:
        raise NotTrained("the classifier has not been trained")
    name, idx, total = (got[c].to_numpy(zero_copy_only=False) for c in ("label", "idx", "total"))
    v, docs = (max(1, len(np.unique(idx))) if model.seen is None else model.vocabulary), sum(r["docs"] for r in labels)
    mass = [total[name == r["label"]].sum() if model.docs is not None else r["mass"] for r in labels]
    base, weights = [np.log(m + model.alpha * v) for m in mass], []
    for r in labels:
        own = np.flatnonzero(name == r["label"])
        own = own[np.argsort(idx[own])]
        weights.append((idx[own].astype(np.int64), np.log(total[own] + model.alpha) - np.log(model.alpha)))
    return LinearModel(tuple(r["label"] for r in labels), np.array([np.log(r["docs"] / docs) for r in labels]), np.array([np.log(model.alpha) - b for b in base]), tuple(weights))


def softmax_ranking(labels: Iterable[str], scores: np.ndarray) -> list[tuple[str, float]]:
    """Probabilities, highest first; ties by label."""
    p = np.exp(scores - scores.max())
    p /= p.sum()
    return sorted(zip(labels, p.tolist()), key=lambda x: (-x[1], x[0]))


def score_dense(df: DataFrame, model: LinearModel, out: str = "prediction") -> DataFrame:
    """Adds a prediction to rows with ``indices`` and ``values``; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(indices, values):
        import pyarrow as pa

        m = shared.value
        rows = []
        size = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        idx, val = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(float)
        owner = np.repeat(np.arange(len(size)), size)
        total = np.bincount(owner, val, len(size))
        scores = np.empty((len(size), len(m.labels)))
        for k, (at, w) in enumerate(m.weights):
            hit = np.searchsorted(at, idx)
            ok = hit < len(at)
            ok[ok] = at[hit[ok]] == idx[ok]
            scores[:, k] = m.bias[k] + total * m.rest[k] + np.bincount(owner[ok], val[ok] * w[hit[ok]], len(size))
        for s in scores:
            ranked = softmax_ranking(m.labels, s)
            rows.append({"label": ranked[0][0], "confidence": ranked[0][1], "alternatives": [{"label": n, "probability": p} for n, p in ranked]})
        alternative = pa.list_(pa.struct([("label", pa.string()), ("probability", pa.float64())]))
        return pa.array(rows, pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("alternatives", alternative)]))

    return df.withColumn(out, predict(F.col("indices"), F.col("values")))


def log_scores(df: DataFrame, model: NaiveBayesModel, key: str = "row_id") -> DataFrame:
    """(key, label, score) for every row and label, by joins: only features that a label has need a row."""
    vocabulary = model.features.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("V"))
    total = model.labels.agg(F.sum("docs").alias("N"))
    facts = model.labels.join(vocabulary).join(total).select("label", F.log(F.col("docs") / F.col("N")).alias("prior"), (F.log(F.lit(model.alpha)) - F.log(F.col("mass") + model.alpha * F.col("V"))).alias("rest"))
    each = explode_features(df, key)
    gain = each.join(model.counts, "idx").groupBy(key, "label").agg(F.sum(F.col("v") * (F.log(F.col("total") + model.alpha) - F.log(F.lit(model.alpha)))).alias("gain"))
    mass = df.select(key, F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("mass_of"))
    full = mass.crossJoin(F.broadcast(facts))  # a row for each label of the model
    return full.join(gain, [key, "label"], "left").select(key, "label", (F.col("prior") + F.col("mass_of") * F.col("rest") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def rank(scores: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, label, score) to (key, prediction): softmax per key, ties by label."""
    w = Window.partitionBy(key)
    e = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("neg"), "label")))
    out = e.groupBy(key).agg(ordered.alias("r"))
    alternatives = F.transform("r", lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("probability")))
    return out.select(key, F.struct(F.col("r")[0]["label"].alias("label"), (-F.col("r")[0]["neg"]).alias("confidence"), alternatives.alias("alternatives")).alias("prediction"))


def score_joined(df: DataFrame, model: NaiveBayesModel, key: str = "row_id") -> DataFrame:
    return rank(log_scores(df, model, key), key)


# -- logistic regression -----------------------------------------------------------------------
class SgdTrainer:
    """Online multinomial logistic regression on sparse vectors."""

    def __init__(self, rate: float = 0.1, decay: float = 0.0, l2: float = 0.0):
        self.rate, self.decay, self.l2, self.step = rate, decay, l2, 0
        self.weights: dict[str, dict[int, float]] = {}
        self.bias: dict[str, float] = {}

    def learn(self, label: str, indices: list[int], values: list[float]) -> None:
        """One step: every known label moves towards its indicator, on the touched features only."""
        self.weights.setdefault(label, {})
        self.bias.setdefault(label, 0.0)
        rate = self.rate / (1.0 + self.decay * self.step)
        names = list(self.weights)
        score = np.array([self.bias[n] + sum(self.weights[n].get(i, 0.0) * v for i, v in zip(indices, values)) for n in names])
        p = np.exp(score - score.max())
        p /= p.sum()
        for n, prob in zip(names, p.tolist()):
            error, w = prob - (n == label), self.weights[n]
            for i, v in zip(indices, values):
                old = w.get(i, 0.0)
                w[i] = old - rate * (error * v + self.l2 * old)
            self.bias[n] -= rate * error
        self.step += 1

    def model(self) -> LinearModel:
        return linear_model({n: sorted(w.items()) for n, w in self.weights.items()}, self.bias)


def linear_model(weights: dict[str, list[tuple[int, float]]], bias: dict[str, float]) -> LinearModel:
    if not bias:
        raise NotTrained("the classifier has not been trained")
    names = tuple(sorted(bias))
    packed = tuple((np.array([i for i, _ in weights.get(n, [])], np.int64), np.array([w for _, w in weights.get(n, [])], float)) for n in names)
    return LinearModel(names, np.array([bias[n] for n in names]), np.zeros(len(names)), packed)


def fit_logistic(observations: DataFrame, epochs: int = 1, seed: int | None = None, rate: float = 0.1, decay: float = 0.0, l2: float = 0.0) -> DataFrame:
    """Weights (label, idx, weight); the bias has idx -1.  ``observations``: (seq, label, indices, values).

    With a seed each epoch has an order of its own, from a hash of ``seq``.  The order-dependent steps run
    in one task, streaming over the sorted rows, an epoch after another."""
    if epochs < 1:
        raise ValueError("training needs an epoch or more")
    rows = observations.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "seq", "label", "indices", "values")
    order = F.col("seq") if seed is None else F.xxhash64(F.lit(seed) + F.col("epoch"), F.col("seq"))
    rows = rows.withColumn("place", order).repartition(1).sortWithinPartitions("epoch", "place", "seq")

    def train(batches):
        import pyarrow as pa

        t = SgdTrainer(rate, decay, l2)
        for b in batches:
            for label, indices, values in zip(*(b[c].to_pylist() for c in ("label", "indices", "values"))):
                t.learn(label, indices, values)
        out = [(n, -1, x) for n, x in t.bias.items()] + [(n, i, x) for n, w in t.weights.items() for i, x in w.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.float64()))], ["label", "idx", "weight"])

    return rows.select("label", "indices", "values").mapInArrow(train, "label string, idx int, weight double")


def logistic_weights(table: DataFrame, dense_bytes: int = DENSE_BYTES) -> LinearModel:
    rows = dense_bytes // 24
    got = table.limit(rows + 1).collect()
    if len(got) > rows:
        raise MemoryError("the model is too large to be broadcast")
    weights: dict[str, list[tuple[int, float]]] = {}
    bias: dict[str, float] = {}
    for r in got:
        if r["idx"] < 0:
            bias[r["label"]] = r["weight"]
        else:
            weights.setdefault(r["label"], []).append((r["idx"], r["weight"]))
    return linear_model({n: sorted(w) for n, w in weights.items()}, bias)


def linear_scores(df: DataFrame, table: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, label, score) of a weight table, by a join."""
    bias = table.filter("idx < 0").select("label", F.col("weight").alias("b"))
    gain = explode_features(df, key).join(table.filter("idx >= 0"), "idx").groupBy(key, "label").agg(F.sum(F.col("v") * F.col("weight")).alias("gain"))
    return df.select(key).crossJoin(F.broadcast(bias)).join(gain, [key, "label"], "left").select(key, "label", (F.col("b") + F.coalesce("gain", F.lit(0.0))).alias("score"))


# -- uncertainty and active learning -----------------------------------------------------------
MARGIN, LEAST_CONFIDENCE, ENTROPY = STRATEGIES = ("MARGIN", "LEAST_CONFIDENCE", "ENTROPY")


def margin(prediction: Column) -> Column:
    """Between the two best labels; 1 if there is only one."""
    a = prediction["alternatives"]
    return F.when(F.size(a) < 2, F.lit(1.0)).otherwise(F.get(a, F.lit(0))["probability"] - F.get(a, F.lit(1))["probability"])


def uncertainty(prediction: Column, strategy: str = MARGIN) -> Column:
    if strategy == MARGIN:
        return -margin(prediction)
    if strategy == LEAST_CONFIDENCE:
        return 1 - prediction["confidence"]
    if strategy == ENTROPY:
        return F.aggregate(prediction["alternatives"], F.lit(0.0), lambda s, x: s - F.when(x["probability"] > 0, x["probability"] * F.log(x["probability"])).otherwise(F.lit(0.0)))
    raise ValueError(f"unknown strategy: {strategy}")


def select_for_review(scored: DataFrame, limit: int, strategy: str = MARGIN, key: str = "row_id") -> DataFrame:
    """The most uncertain rows (a top-k without a full sort), with their margin."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    p = F.col("prediction")
    return scored.withColumn("uncertainty", uncertainty(p, strategy)).withColumn("margin", margin(p)).orderBy(F.desc("uncertainty"), key).limit(limit)


def sample_pool(df: DataFrame, scan_limit: int, need: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """A uniform window of ``max(scan_limit, need)`` rows, or all of them if ``scan_limit`` is 0."""
    return df if scan_limit <= 0 else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(max(scan_limit, need))


def metrics(observations: DataFrame) -> DataFrame:
    """Observations per label."""
    return observations.groupBy("label").agg(F.count(F.lit(1)).alias("observations"))


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "seq long, label string, indices array<int>, values array<float>")
