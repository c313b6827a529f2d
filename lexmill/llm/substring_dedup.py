"""Removal of passages of 50 or more words that an earlier document has, by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document (words are runs of non-white-space, unchanged).  A word goes
if a window covers it whose word sequence also starts in a document with a smaller id.

Method.  Documents with equal word sequences are settled first: all but those with the least id lose every word (if
they have a window at all).  In each window the ``GRAM`` words with the least hash are its *anchor*.  A window is read from there: to its right end,
then from the anchor to the left; the anchor is the first prefix of what is read, and equal windows have equal prefixes of any
length.  Anchors of which only one id has any are dropped, with all their windows, before any text moves.  The prefix grows with its group:

* an anchor with up to ``GROUP_ROWS`` documents is a memory-sized group.  Its windows are sent as text
  segments, and a suffix tree is built over them (suffixes in order with the lengths of their common prefixes, a node
  being a run of neighbours).  What hangs under an internal node of ``WINDOW`` words or more repeats, and goes
  unless it belongs to the least id there.
* a more frequent prefix is lengthened to the whole window.  A group is then one node of that depth, for which a partial
  aggregate of the least id is enough, whatever its size; the windows that are not the least id's go (an anti-join by window and id, so
  that a window that a third of the documents have is no hot key).

``maximal_repeats`` lists the deep internal nodes of a group whose suffixes differ in the word before them.

Texts are shuffled twice: to be cut into segments and windows, and to meet their spans.  Documents without either, and
copies, have their results from the first scan.

Ids: a null id counts as greater than any other, and as equal to other null ids.
Defined results: null and empty texts have no words; documents under 50 words lose nothing; rows that repeat
an id don't remove each other's words, and rows that repeat id and text lose the same; of equal ids none counts as smaller (no other ties arise);
an empty table gives an empty table; texts of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stage, text_of

WINDOW, GRAM, GROUP_ROWS, BATCH_WORDS = 50, 10, 1_000, 300_000

_NO_ID = (1 << 63) - 1
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Word to XXH64; bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


def word_hashes(words: list[bytes], known: _Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A rolling hash of every run of ``n`` words (``len(h) - n + 1`` of them), by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    have, out, done = h, None, 0
    size, power = 1, base
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:  # what is there goes behind the longer run
                m = len(have) - done
                out = have[: max(0, m)] * pow_u64(base, done) + out[size : size + max(0, m)]
                done += size
        if size * 2 > n:
            break
        have = have[:-size] * power + have[size:]
        size *= 2
        power = pow_u64(base, size)
    return _mix(out[: len(h) - n + 1])


def pow_u64(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its anchor's hash and the anchor's place."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = gram_hashes(h, gram)
    width = window - gram + 1
    # The least of `width` grams, the leftmost on a tie: 32 bits of the hash over the place.
    bits = 32
    key = (g >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    low = key
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    place = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    return g[place], place


def runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values) != 1)
    return list(zip(sorted_values[np.r_[0, cut + 1]].tolist(), sorted_values[np.r_[cut, len(sorted_values) - 1]].tolist()))


def _first_windows(h: np.ndarray, window: int) -> np.ndarray:
    """Which windows are the first of their sequence in the document."""
    w = gram_hashes(h, window)
    keep = np.zeros(len(w), bool)
    keep[np.unique(w, return_index=True)[1]] = True
    return keep


# -- the passes over texts -----------------------------------------------------------------------
def _scan(window: int, gram: int):
    """Per document: number of words, the SHA-256 of the sequence, its distinct anchors."""
    known = _Words()
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            n, sha, found = [], [], []
            for t in b["text"].to_pylist():
                words = t.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(np.unique(anchors(word_hashes(words, known), window, gram)[0]).view(np.int64) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["did"], b["th"], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


#: A segment of an anchor's windows (a: the anchor, words), or a whole window of a more frequent one (a, b: its hash; no words).
_PIECES = "a long, b long, did long, th long, start long, words binary"


def _cut(window: int, gram: int):
    known = _Words()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def segments(rows):
        a, did, th, start, words = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(did), pa.array(th), pa.array(start), pa.array(words, pa.binary())], schema=schema)

    def windows(parts):
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.binary())], schema=schema)

    def run(batches):
        for batch in batches:
            rows, size, whole, n = [], 0, [], 0
            for did, th, t, light, heavy in zip(*(batch[c].to_pylist() for c in ("did", "th", "text", "light", "heavy"))):
                words = t.split()
                h = word_hashes(words, known)
                value, place = anchors(h, window, gram)
                value, first = value.view(np.int64), _first_windows(h, window)
                spots = np.flatnonzero(first & np.isin(value, np.array(light, np.int64))) if light else ()
                if len(spots):
                    new = np.flatnonzero(np.r_[True, (np.diff(spots) != 1) | (np.diff(place[spots]) != 0)])
                    for i, j in zip(spots[new].tolist(), spots[np.r_[new[1:], len(spots)] - 1].tolist()):
                        rows.append((int(value[i]), did, th, i, b" ".join(words[i : j + window])))
                        size += len(rows[-1][-1])
                spots = np.flatnonzero(first & np.isin(value, np.array(heavy, np.int64))) if heavy else ()
                if len(spots):
                    wa, wb = gram_hashes(h, window)[spots], gram_hashes(_mix(h), window, _BASE2)[spots]
                    whole.append((wa.view(np.int64), wb.view(np.int64), np.full(len(spots), did), np.full(len(spots), th), spots))
                    n += len(spots)
                if size > 8_000_000:
                    yield segments(rows)
                    rows, size = [], 0
                if n > 200_000:
                    yield windows(whole)
                    whole, n = [], 0
            if rows:
                yield segments(rows)
            if whole:
                yield windows(whole)

    return run


# -- the trees ---------------------------------------------------------------------------------
class SuffixTree:
    """The suffixes of some word lists that have at least ``least`` words, in order, and with each the number of
    words that it shares with the one before (exact below 128 words, at least 127 above)."""

    LEVELS = 7

    def __init__(self, segments: list[list[bytes]], least: int):
        size = np.array([len(s) for s in segments], np.int64)
        first = np.cumsum(size + 1) - size - 1  # a segment ends with a mark of its own
        total = int((size + 1).sum())
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for s in segments for w in s), np.int64, int(size.sum()))
        rank = np.empty(total, np.int64)
        ends = first + size
        inside = np.ones(total, bool)
        inside[ends] = False
        rank[inside], rank[ends] = word, len(ids) + np.arange(len(segments))
        self.levels = [rank]
        for k in range(self.LEVELS - 1):
            step = 1 << k
            after = np.r_[rank[step:], np.full(min(step, total), -1)][:total]
            rank = np.unique((rank << 32) | (after + 1), return_inverse=True)[1]
            self.levels.append(rank)
        self.total = total
        owner = np.repeat(np.arange(len(segments)), size + 1)
        place = np.arange(total) - first[owner]
        at = np.flatnonzero(place + least <= size[owner])
        self.at = at[np.lexsort((self._rank(at, 1 << (self.LEVELS - 1)), self.levels[-1][at]))]
        self.segment, self.place = owner[self.at], place[self.at]
        self.shared = np.r_[0, self._common(self.at[:-1], self.at[1:])] if len(self.at) else np.empty(0, np.int64)

    def _rank(self, at: np.ndarray, skip: int) -> np.ndarray:
        there = at + skip
        return np.where(there < self.total, self.levels[-1][np.minimum(there, self.total - 1)], -1)

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each two suffixes."""
        out = np.zeros(len(x), np.int64)
        for k in range(self.LEVELS - 1, -1, -1):
            a, b = np.minimum(x + out, self.total - 1), np.minimum(y + out, self.total - 1)
            out += (self.levels[k][a] == self.levels[k][b]) * (1 << k)
        return out

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix (in order) the number of the node, or leaf, that it hangs under at ``depth``."""
        return np.cumsum(self.shared < depth) - 1

    def internal(self, depth: int):
        """The internal nodes of at least ``depth`` words, as (words, first suffix, last suffix)."""
        open_: list[tuple[int, int]] = []
        for k, n in enumerate([*self.shared.tolist(), 0]):
            start = k - 1
            while open_ and open_[-1][0] > n:
                d, start = open_.pop()
                yield d, start, k - 1
            if n >= depth and (not open_ or open_[-1][0] < n):
                open_.append((n, start))


def maximal_repeats(segments: list[list[bytes]], least: int) -> list[tuple[list[bytes], int]]:
    """The word sequences of ``least`` words or more that occur more than once and lose an occurrence by any further word, with
    their numbers of occurrences."""
    tree, out = SuffixTree(segments, least), []
    for depth, i, j in tree.internal(least):
        before = {segments[s][p - 1] if p else (s,) for s, p in zip(tree.segment[i : j + 1].tolist(), tree.place[i : j + 1].tolist())}
        if len(before) > 1:
            s, p = int(tree.segment[i]), int(tree.place[i])
            out.append((segments[s][p : p + depth], j - i + 1))
    return out


def tree_repeats(did: list[int], segments: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each segment the runs of its suffixes under a deep node that a smaller id has, too."""
    tree, out = SuffixTree(segments, window), [[] for _ in segments]
    if not len(tree.at):
        return out
    node, ids = tree.nodes(window), np.array(did)[tree.segment]
    least = np.full(int(node[-1]) + 1, _NO_ID)
    np.minimum.at(least, node, ids)
    gone = np.flatnonzero(ids > least[node])
    gone = gone[np.lexsort((tree.place[gone], tree.segment[gone]))]
    segment, place = tree.segment[gone], tree.place[gone]
    new = np.r_[True, (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)][: len(gone)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(gone)][: len(first)] - 1
    for k, i, j in zip(segment[first].tolist(), place[first].tolist(), place[last].tolist()):
        out[k].append((i, j))
    return out


def _trees(window: int):
    """Runs over segments sorted by anchor; several small groups make one tree."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def some(rows):
        out = []
        for (_, did, th, start, _), found in zip(rows, tree_repeats([r[1] for r in rows], [r[4].split() for r in rows], window)):
            out += [(did, th, start + i, start + j) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema) if out else None

    def run(batches):
        held, letters, mark = [], 0, None
        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("a", "did", "th", "start", "words"))):
                if letters > BATCH_WORDS * 6 and r[0] != mark:
                    if (out := some(held)) is not None:
                        yield out
                    held, letters = [], 0
                held.append(r)
                letters += len(r[4])
                mark = r[0]
        if held and (out := some(held)) is not None:
            yield out

    return run


def _finish(window: int, texts: bool):
    known = _Words()
    names = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept"][: 6 if texts else 5]
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for b in batches:
            n, gone, removed, sha, kept = [], [], [], [], []
            for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                words = t.split()
                start = np.zeros(max(0, len(words) - window + 1), bool)
                for s in spans or ():
                    start[s["first"] : s["last"] + 1] = True
                if spans:
                    w = gram_hashes(word_hashes(words, known), window)
                    start = np.isin(w, w[start])  # the same sequence elsewhere in this document
                edge = np.zeros(len(words) + 1, np.int64)
                edge[: len(start)] += start
                edge[len(words) + 1 - len(start) :] -= start
                out = np.cumsum(edge[:-1]) > 0
                n.append(len(words))
                gone.append(int(out.sum()))
                removed.append([{"first": i, "last": j} for i, j in runs(np.flatnonzero(out))])
                left = b" ".join([x for x, o in zip(words, out.tolist()) if not o])
                sha.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode("utf-8", "replace"))
            columns = [b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, removed (the runs of words that go, as first and last place),
    kept_sha256, and with ``texts`` kept (the words that stay, joined by one space)."""
    if not 1 <= gram <= window < 1 << SuffixTree.LEVELS:
        raise ValueError("gram must be from 1 to window, and window below 128")
    text = text_of(df[text_col])
    doc = df[id_col].cast("long")
    docs = df.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    scanned = stage(docs.mapInArrow(_scan(window, gram), "doc_id long, did long, th long, n_words long, sha binary, anchors array<long>"), "anchors")

    # a document is a copy unless it has the least id of its sequence; by id and sequence, so that no text is a hot key
    reps = scanned.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("did").alias("r_did")).withColumnRenamed("sha", "r_sha")
    state = scanned.join(reps, (F.col("did") == F.col("r_did")) & (F.col("sha") == F.col("r_sha")), "left")
    state = stage(state.select("doc_id", "did", "th", "n_words", "sha", "anchors", (F.col("r_did").isNull() & (F.col("n_words") >= window)).alias("copy")), "copies")

    spots = state.filter(~F.col("copy")).select("did", "th", F.explode("anchors").alias("anchor"))
    shared = spots.groupBy("anchor").agg(F.min("did").alias("low"), F.max("did").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select(F.col("anchor").alias("s_anchor"), (F.col("n") > group_rows).alias("often"))
    chosen = spots.join(shared, F.col("anchor") == F.col("s_anchor")).groupBy("did", "th").agg(F.collect_set(F.when(~F.col("often"), F.col("anchor"))).alias("light"), F.collect_set(F.when(F.col("often"), F.col("anchor"))).alias("heavy"))
    chosen = stage(chosen.select(F.col("did").alias("d"), F.col("th").alias("t"), "light", "heavy"), "shared-anchors")
    same = (F.col("did") == F.col("d")) & (F.col("th") == F.col("t"))
    pieces = stage(docs.join(chosen, same).select("did", "th", "text", "light", "heavy").mapInArrow(_cut(window, gram), _PIECES), "pieces")

    spans = pieces.filter("b is null").select("a", "did", "th", "start", "words").repartition("a").sortWithinPartitions("a").mapInArrow(_trees(window), "did long, th long, first long, last long")
    whole = pieces.filter("b is not null").select("a", "b", "did", "th", "start")
    least = whole.groupBy("a", "b").agg(F.min("did").alias("l_did")).select(F.col("a").alias("l_a"), F.col("b").alias("l_b"), "l_did")
    later = whole.join(least, (F.col("a") == F.col("l_a")) & (F.col("b") == F.col("l_b")) & (F.col("did") == F.col("l_did")), "left_anti")
    spans = spans.union(later.select("did", "th", "start", "start"))
    spans = stage(spans.groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")).select(F.col("did").alias("d"), F.col("th").alias("t"), "spans"), "spans")

    names = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_sha256 string" + ", kept string" * texts
    if texts:
        cut = docs.join(state.select(F.col("did").alias("c_did"), F.col("th").alias("c_th"), F.when(F.col("copy"), F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - window).alias("last")))).alias("whole")).distinct(), (F.col("did") == F.col("c_did")) & (F.col("th") == F.col("c_th"))).join(spans, same, "left")
        return cut.select("doc_id", "text", F.coalesce("whole", "spans").alias("spans")).mapInArrow(_finish(window, True), names)
    cut = docs.join(spans, same).select("doc_id", "text", "spans").mapInArrow(_finish(window, False), names)
    none = F.array().cast("array<struct<first:long,last:long>>")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - 1).alias("last")))
    rest = state.join(spans, same, "left_anti").select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("copy"), all_).otherwise(none).alias("removed"), F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    return cut.unionByName(rest)
