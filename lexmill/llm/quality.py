"""Quality classifier from weak labels.

Ten heuristic labellers look at a document's words and vote good, bad or not at all.  Expectation-maximisation
(two classes, labellers independent given the class) estimates how often each labeller errs on either class (a vote that is withheld says nothing),
and with that a posterior for every pattern of votes.  There are at most ``3 ** 10`` patterns, so
their counts over *all* documents are a table of bounded size, and the EM on it equals one over all rows.

The posteriors of a bounded sample (``train_rows`` documents with the least hashes of their ids and texts) train a linear
scorer over hashed features: the shares of word shapes, of repeated words and of distinct words.  Its
weights are ``DIMS`` numbers.  A document is kept if its score (probability to be good) is at least ``threshold``.

Each document is read whole, and once: its features are staged, by ``keep_good`` beside its row, so that texts are neither read
again by the labellers nor shuffled.

Defined results: null text counts as empty, and a text without words has score 0; texts of any length are read whole; rows that repeat an id are rows
of their own; equal rows have equal scores; documents that tie for the training sample's last places are alike in votes and id hash, and their order changes nothing; an empty table gives an empty table and a model that keeps everything; ``keep_good`` keeps all
columns whatever their names.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import stage, text_of

TRAIN_ROWS, DIMS, THRESHOLD, EPOCHS = 8_000, 1 << 12, 0.5, 300
ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("shouting", "exclamations", "symbols", "bare marks", "repeats", "variety", "plain words", "sentences", "word length", "no words")

#: Of a shape: all capitals, exclamation marks, symbols, no letter or digit, plain word, end of a sentence.
_FLAGS = tuple(re.compile(f, re.S) for f in (r"AA[^a]*\Z", r".*!!\Z", r".*[#$%&*^~=<>{}|@\\]", r"[^aA9]+\Z", r"A?(AA)?a?(['’-]a)?[.,;:!?]?\Z", r".*[.!?]\Z"))
_RUN = re.compile(r"([a9])\1+|(A)A+")


def shape(word: str) -> str:
    """Letters become a or A, digits 9; runs of a and 9 become one, runs of A two."""
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(lambda m: m[1] or "AA", s)


class _Shapes(dict):
    """Word to the number of its shape; bounded, with what is known of each shape beside it."""

    def __init__(self):
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.number: dict[str, int] = {}
        self.flags, self.dim = [], []

    def __missing__(self, w: str) -> int:
        s = shape(w)
        k = self.number.get(s)
        if k is None:
            k = self.number[s] = len(self.number)
            self.flags.append([bool(f.match(s)) for f in _FLAGS])
            self.dim.append(feature("shape " + s))
        self[w] = k
        return k


def feature(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), 11) % DIMS


def _vote(x: float, good, bad) -> int:
    return BAD if bad(x) else GOOD if good(x) else ABSTAIN


def describe(text: str, shapes: _Shapes) -> tuple[int, list[int], list[float]]:
    """A document's votes (as one number) and its hashed features."""
    words = text.split()
    n = len(words)
    if not n:
        return BAD * 3 ** (len(LABELLERS) - 1), [], []
    if len(shapes) > 400_000 or len(shapes.number) > 20_000:
        shapes.renew()
    kinds, counts = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, n), return_counts=True)
    kinds = kinds.tolist()
    shares = counts / n
    flags = np.array([shapes.flags[k] for k in kinds], float)
    shout, bang, symbol, bare, plain, end = (shares @ flags).tolist()
    repeat = sum(map(operator.eq, words, words[1:])) / max(1, n - 1)
    variety = len(set(words)) / n
    length = sum(map(len, words)) / n
    few = n < 20
    votes = (
        _vote(shout, lambda x: x < 0.05, lambda x: x > 0.3),
        _vote(bang, lambda x: x < 0.05, lambda x: x > 0.2),
        _vote(symbol, lambda x: x < 0.05, lambda x: x > 0.25),
        _vote(bare, lambda x: x < 0.02, lambda x: x > 0.12),
        _vote(repeat, lambda x: x < 0.08, lambda x: x > 0.3 and n > 3),
        _vote(variety, lambda x: x > 0.5, lambda x: x < 0.2 and not few),
        _vote(plain, lambda x: x > 0.9, lambda x: x < 0.5),
        ABSTAIN if few else _vote(end, lambda x: 0.01 < x < 0.35, lambda x: x > 0.9),
        _vote(length, lambda x: 3 <= x <= 9, lambda x: x > 25),
        GOOD,
    )
    weight: dict[int, float] = {}
    for k, s in zip(kinds, shares.tolist()):
        weight[shapes.dim[k]] = weight.get(shapes.dim[k], 0.0) + s
    for name, x in (("repeat", repeat), ("variety " + str(min(9, int(variety * 10))) if not few else "few", 1.0 if not few else 0.0)):
        d = feature(name)
        weight[d] = weight.get(d, 0.0) + x
    return sum(v * 3**k for k, v in enumerate(votes)), list(weight), list(weight.values())


# -- the label model ---------------------------------------------------------------------------
@dataclass(frozen=True)
class LabelModel:
    prior_bad: float
    rates: np.ndarray  # labeller, class (good, bad), vote

    def posterior_bad(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the bad class for each pattern number."""
        votes = patterns[:, None] // 3 ** np.arange(self.rates.shape[0]) % 3
        log = np.log([1 - self.prior_bad, self.prior_bad]) + np.log(self.rates[np.arange(self.rates.shape[0]), :, votes]).sum(1)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """EM over the patterns of votes and their numbers of documents."""
    patterns, counts = np.asarray(patterns, np.int64), np.asarray(counts, float)
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    bad_votes = (votes == BAD).sum(1)
    bad = np.where(bad_votes == 0, 0.02, np.where(bad_votes == 1, 0.6, 0.95))
    if not len(patterns):
        return LabelModel(0.5, np.full((labellers, 2, 3), 1 / 3))
    for _ in range(rounds):
        prior = (counts @ bad + smooth) / (counts.sum() + 2 * smooth)
        rates = np.empty((labellers, 2, 3))
        for c, p in enumerate((1 - bad, bad)):
            for v in (GOOD, BAD):
                rates[:, c, v] = (counts * p) @ (votes == v) + smooth
        rates[:, :, ABSTAIN] = 0
        rates /= rates.sum(2, keepdims=True)
        rates[:, :, ABSTAIN] = 1  # a labeller that doesn't vote says nothing
        model = LabelModel(float(prior), rates)
        new = model.posterior_bad(patterns)
        done = np.abs(new - bad).max() < 1e-9
        bad = new
        if done:
            break
    return model


# -- the scorer --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, dims, values) -> float:
        if not len(dims):  # no words
            return 0.0
        z = self.bias + float(np.dot(self.weights[np.asarray(dims, np.int64)], np.asarray(values)))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def fit_scorer(rows: list[tuple[list[int], list[float]]], good: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels: full-batch Adam, so the order of rows doesn't matter."""
    if not rows:
        return Scorer(np.zeros(DIMS), 1.0)
    size = np.array([len(d) for d, _ in rows])
    dims = np.fromiter((x for d, _ in rows for x in d), np.int64, int(size.sum()))
    vals = np.fromiter((x for _, v in rows for x in v), float, int(size.sum()))
    owner = np.repeat(np.arange(len(rows)), size)
    w, first, second = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for k in range(1, epochs + 1):
        z = w[-1] + np.bincount(owner, vals * w[dims], len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) / len(rows)
        g = np.append(np.bincount(dims, vals * err[owner], DIMS) + l2 * w[:-1] / 10, err.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Scorer(w[:-1], float(w[-1]))


# -- in Spark ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    scorer: Scorer
    threshold: float = THRESHOLD


_FEATURES = [T.StructField("pick", T.LongType()), T.StructField("votes", T.LongType()), T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("vals", T.ArrayType(T.DoubleType()))]


def _features(df: DataFrame, id_col: str, text_col: str, kept: list) -> DataFrame:
    """The columns ``kept`` of ``df`` as k0, k1, ..., and the features of its text."""
    text = text_of(df[text_col])
    rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(kept)], F.xxhash64(df[id_col], text).alias("pick"), text.alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        shapes = _Shapes()
        for b in batches:
            found = [describe(t, shapes) for t in b["__text"].to_pylist()]
            votes, dims, vals = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(votes, pa.int64()), pa.array(dims, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float64()))], [*names, "votes", "dims", "vals"])

    return stage(rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], *_FEATURES])), "features")


def fit(features: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> QualityModel:
    """``features``: the staged table.  To the driver come the patterns (bounded) and ``train_rows`` rows."""
    seen = features.groupBy("votes").count().collect()
    labels = fit_label_model(np.array([r["votes"] for r in seen], np.int64), np.array([r["count"] for r in seen]))
    n = sum(r["count"] for r in seen)
    share = min(1.0, 2.0 * train_rows / max(1, n))
    near = features.filter(F.col("pick") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else features
    sample = near.orderBy("pick", "votes").limit(train_rows).select("votes", "dims", "vals").collect()
    sample.sort(key=lambda r: (r["votes"], r["dims"], r["vals"]))
    good = 1 - labels.posterior_bad(np.array([r["votes"] for r in sample], np.int64)) if sample else np.empty(0)
    return QualityModel(labels, fit_scorer([(r["dims"], r["vals"]) for r in sample], good), threshold)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, label_posterior (probability to be good), keep."""
    features = _features(df, id_col, text_col, [df[id_col].cast("long")])
    model = fit(features, train_rows, threshold)
    names = ["doc_id", "score", "label_posterior", "keep"]

    def run(batches):
        for b in batches:
            s = np.array([model.scorer.score(d, v) for d, v in zip(b["dims"].to_pylist(), b["vals"].to_pylist())])
            p = 1 - model.labels.posterior_bad(b["votes"].to_numpy()) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64()), pa.array(p, pa.float64()), pa.array(s >= model.threshold, pa.bool_())], names)

    return features.select(F.col("k0").alias("doc_id"), "votes", "dims", "vals").mapInArrow(run, "doc_id long, score double, label_posterior double, keep boolean")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the classifier keeps."""
    features = _features(df, id_col, text_col, [df[c] for c in df.columns])
    model = fit(features, train_rows, threshold)

    @F.pandas_udf("boolean")
    def good(dims: pd.Series, vals: pd.Series) -> pd.Series:
        return pd.Series([model.scorer.score(d, v) >= model.threshold for d, v in zip(dims, vals)], dtype=bool)

    return features.filter(good("dims", "vals")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)])
