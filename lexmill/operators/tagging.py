"""Linear-chain conditional random field for token tags.

Training is online and depends on the order of its sequences, so it runs in one task over rows sorted by ``seq``; tagging
runs everywhere with the weights at hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARY, AFFIX = "^", 3


def token_features(tokens: list[tuple[str, str]]) -> list[list[str]]:
    """Six features for each (text, type)."""
    out = []
    for k, (text, kind) in enumerate(tokens):
        low = text.lower()
        before = tokens[k - 1][1] if k else BOUNDARY
        after = tokens[k + 1][1] if k + 1 < len(tokens) else BOUNDARY
        out.append([f"type={kind}", f"word={low}", f"prefix={low[:AFFIX]}", f"suffix={low[-AFFIX:]}", f"prevType={before}", f"nextType={after}"])
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


@dataclass
class Crf:
    """Weights in arrays that grow with tags and features."""

    rate: float = 0.1
    decay: float = 0.0
    l2: float = 0.0
    step: int = 0
    tags: list[str] = field(default_factory=list)
    features: dict[str, int] = field(default_factory=dict)
    state: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # feature, tag
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # from, to
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _grow(self, tags: list[str], features: list[list[str]]) -> None:
        for t in tags:
            if t not in self.tags:
                if not t or t.isspace():
                    raise ValueError("a tag must not be blank")
                self.tags.append(t)
        for row in features:
            for f in row:
                self.features.setdefault(f, len(self.features))
        n, m = len(self.tags), len(self.features)
        if self.state.shape != (m, n):
            room = np.zeros((m, n))
            room[: self.state.shape[0], : self.state.shape[1]] = self.state
            self.state = room
        if len(self.start) != n:
            k = len(self.start)
            move, start = np.zeros((n, n)), np.zeros(n)
            move[:k, :k], start[:k] = self.move, self.start
            self.move, self.start = move, start

    def _emit(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.state[[self.features[f] for f in row if f in self.features]].sum(0) if self.state.size else np.zeros(len(self.tags)) for row in features])

    def learn(self, tokens: list[tuple[str, str]], tags: list[str]) -> None:
        """One step of gradient ascent: weights of tokens and of the start first, then those of moves, whose
        expectations use the fresh token weights with the old sums."""
        if len(tokens) != len(tags):
            raise ValueError("tokens and tags must have the same length")
        if not tokens:
            return
        rows = token_features(tokens)
        self._grow(tags, rows)
        n, k = len(tokens), len(self.tags)
        rate = self.rate / (1.0 + self.decay * self.step)
        emit = self._emit(rows)
        ahead, behind = np.zeros((n, k)), np.zeros((n, k))
        ahead[0] = self.start + emit[0]
        for i in range(1, n):
            ahead[i] = _lse(ahead[i - 1][:, None] + self.move, 0) + emit[i]
        for i in range(n - 2, -1, -1):
            behind[i] = _lse(self.move + (emit[i + 1] + behind[i + 1])[None, :], 1)
        z = _lse(ahead[-1], 0)
        gold = np.array([self.tags.index(t) for t in tags])
        for i in range(n):
            delta = -np.exp(ahead[i] + behind[i] - z)
            delta[gold[i]] += 1.0
            for f in rows[i]:
                at = self.features[f]
                self.state[at] += rate * (delta - self.l2 * self.state[at])
            if i == 0:
                self.start += rate * (delta - self.l2 * self.start)
        fresh = self._emit(rows)
        for i in range(1, n):
            # every move's expectation sees only its own weight, so all of them change together
            edge = -np.exp(ahead[i - 1][:, None] + self.move + (fresh[i] + behind[i])[None, :] - z)
            edge[gold[i - 1], gold[i]] += 1.0
            self.move += rate * (edge - self.l2 * self.move)
        self.step += 1

    def tag(self, tokens: list[tuple[str, str]]) -> list[str]:
        """The best path; ties go to the tag that was seen first."""
        if not self.tags:
            raise RuntimeError("the tagger has not been trained")
        if not tokens:
            return []
        emit = self._emit(token_features(tokens))
        best, back = self.start + emit[0], []
        for e in emit[1:]:
            all_ = best[:, None] + self.move
            back.append(all_.argmax(0))
            best = all_.max(0) + e
        at = int(best.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return [self.tags[i] for i in reversed(path)]


def fit_crf(df: DataFrame, epochs: int = 1, rate: float = 0.1, decay: float = 0.0, l2: float = 0.0) -> DataFrame:
    """``df``: (seq, tokens array<struct<text,type,...>>, tags array<string>).  Weights as a table (kind, a, b, weight):
    ``tag`` rows keep the order of tags, ``state`` (feature, tag), ``move`` (from, to), ``start`` (tag)."""
    rows = df.select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"), "seq", F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), t["type"].alias("type"))).alias("tokens"), "tags")

    def train(batches):
        import pyarrow as pa

        crf = Crf(rate, decay, l2)
        for b in batches:
            for tokens, tags in zip(b["tokens"].to_pylist(), b["tags"].to_pylist()):
                crf.learn([(t["text"], t["type"]) for t in tokens], tags)
        out = [("tag", t, "", float(k)) for k, t in enumerate(crf.tags)] + [("start", t, "", float(w)) for t, w in zip(crf.tags, crf.start)]
        out += [("move", a, b, float(crf.move[i, j])) for i, a in enumerate(crf.tags) for j, b in enumerate(crf.tags)]
        out += [("state", f, t, float(crf.state[i, j])) for f, i in crf.features.items() for j, t in enumerate(crf.tags)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["kind", "a", "b", "weight"])

    return rows.repartition(1).sortWithinPartitions("epoch", "seq").select("tokens", "tags").mapInArrow(train, "kind string, a string, b string, weight double")


def load_crf(table: DataFrame, max_rows: int = 5_000_000) -> Crf:
    got = table.limit(max_rows + 1).collect()
    if len(got) > max_rows:
        raise MemoryError("the tagger is too large for one process")
    crf = Crf()
    crf._grow([r["a"] for r in sorted((r for r in got if r["kind"] == "tag"), key=lambda r: r["weight"])], [[r["a"] for r in got if r["kind"] == "state"]])
    of = {t: k for k, t in enumerate(crf.tags)}
    for r in got:
        if r["kind"] == "start":
            crf.start[of[r["a"]]] = r["weight"]
        elif r["kind"] == "move":
            crf.move[of[r["a"]], of[r["b"]]] = r["weight"]
        elif r["kind"] == "state":
            crf.state[crf.features[r["a"]], of[r["b"]]] = r["weight"]
    return crf


def tag_tokens(tokens: Column, crf: Crf) -> Column:
    """Tags of a token array."""

    @F.arrow_udf("array<string>")
    def tagged(rows):
        import pyarrow as pa

        return pa.array([None if r is None else crf.tag([(t["text"], t["type"]) for t in r]) for r in rows.to_pylist()], pa.list_(pa.string()))

    return tagged(tokens)
