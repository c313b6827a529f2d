"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprint: A-Z in lower case, words are runs of non-white-space, shingles are ``width`` consecutive words (repeats
count; a shorter text is one shingle; a text without words has fingerprint zero); a bit is set if it
is set in more than half of the shingles' XXH64 (seed 42).

Links: two fingerprints are linked at ``radius`` = 4 or fewer differing bits.  Equal fingerprints are one node.
The 64 bits are cut into six blocks; with four differences at least two blocks agree, so every link
lies in a bucket of one of the 15 pairs of blocks.  A bucket above ``bucket_rows`` is dealt again by five
blocks of its other bits (one of which must agree), as often as needed: no bucket is capped and
none is held whole beyond that bound.

In a bucket the fingerprints are sorted by Gray rank and built into a tree.  A node keeps the bits
that all its members share; bits that its parent has already are left out of it, so a search
adds up differences on its way down and drops a whole group as soon as the sum exceeds the
radius.  Groups that are in the searching fingerprint's component already are dropped, too, and a task
gives only a spanning star of each component, never all pairs of a group.

``near_dedup`` works with a similarity: two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or
more.  Fingerprints of 256 bits over the distinct shingles name the candidates: at most 72 bits differ (a similarity of about 0.5), and one of 64
keys of 16 bits is shared (of 1,600 random pairs at 0.85 99.2 % did, at 0.82 99.3 %, at 0.8 97.6 %), or, where a text has up to 64
shingles, one of the least fifth of its shingles, which every such pair shares.  Within each component of candidates
the links are then decided on the shingle sets, and only these links make groups.

Defined results: null and empty texts have fingerprint zero and are linked to each other; rows that
repeat an id share one component if their texts do; a component of rows without id has a null component_id; an
empty table gives an empty table; texts of any length are read whole, in blocks of shingles; of a component the least id stays, of rows that repeat it
the one with the least text hash; ``near_components`` doesn't read other columns, and ``near_dedup`` keeps all columns whatever their names.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import spread_join, stage, text_of
from lexmill.llm.components import connected_components

WIDTH, RADIUS, BUCKET_ROWS, FANOUT, SEED = 4, 4, 20_000, 8, 42
BLOCKS = (11, 11, 11, 11, 10, 10)


# -- fingerprints ------------------------------------------------------------------------------
def shingle_hashes(text: str, width: int = WIDTH):
    """XXH64 of each shingle, in blocks of bounded size."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six white-space characters
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    for i in range(0, len(words) - width + 1, 65536):
        last = min(i + 65536, len(words) - width + 1)
        yield np.array([h(joined[s : e - 1], SEED) for s, e in zip(starts[i:last], ends[i + width - 1 : last + width - 1])], np.uint64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    if not n:
        return 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), h (XXH64 of the text, to tell rows apart)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp), b["h"]], ["doc_id", "fp", "h"])

    text = text_of(df[text_col])
    return df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, fp long, h long")


# -- the index ---------------------------------------------------------------------------------
def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of a code word in Gray order."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class GrayTree:
    """Distinct fingerprints in Gray order under nodes of shared bits."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.values, self.fanout = values, fanout
        both = [(values, values)]  # AND and OR of the members, from the leaves up
        while len(both[-1][0]) > fanout:
            at = np.arange(0, len(both[-1][0]), fanout)
            both.append((np.bitwise_and.reduceat(both[-1][0], at), np.bitwise_or.reduceat(both[-1][1], at)))
        self.levels = []  # from the top: pattern, own mask
        above = None
        for low, high in reversed(both):
            mask = ~(low ^ high)
            own = mask if above is None else mask & ~np.repeat(above, fanout)[: len(mask)]
            self.levels.append((low, own))
            above = mask

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level a node's label if all its members have it, else -1."""
        low = high = label
        out = [label]
        for _ in self.levels[1:]:
            at = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def search(self, first: int, last: int, radius: int, label: np.ndarray, same: list[np.ndarray]):
        """Pairs (i, j), i in first..last-1, j > i, at most ``radius`` apart and not yet in one component."""
        n, f = len(self.values), self.fanout
        who = np.repeat(np.arange(first, last), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), last - first)
        total = np.zeros(len(who), np.uint8)
        span = f ** (len(self.levels) - 1)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                who, total = np.repeat(who, f), np.repeat(total, f)
                node = (node[:, None] * f + np.arange(f)).ravel()
                keep = node < len(pattern)
                who, node, total = who[keep], node[keep], total[keep]
            keep = ((node + 1) * span - 1 > who) & (same[depth][node] != label[who])
            who, node, total = who[keep], node[keep], total[keep]
            total = total + np.bitwise_count((self.values[who] ^ pattern[node]) & own[node])
            keep = total <= radius
            who, node, total = who[keep], node[keep], total[keep]
            span //= f
        keep = (node > who) & (node < n)
        return who[keep], node[keep]


class Forest:
    """Union-find over fingerprints; the least value of a component is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def stars(self) -> tuple[list[int], list[int]]:
        members = [x for x in self.up if self.find(x) != x]
        return members, [self.find(x) for x in members]


def link_bucket(values: np.ndarray, radius: int, forest: Forest) -> None:
    """Adds to ``forest`` the components of one bucket's distinct fingerprints (uint64)."""
    values = values[np.argsort(gray_rank(values))]
    names = values.view(np.int64).tolist()
    tree, n = GrayTree(values), len(values)
    label = np.arange(n)
    same, first = tree.uniform(label), 0
    while first < n - 1:
        last = min(n - 1, first + max(1, min(64, 4_000_000 // n)))
        i, j = tree.search(first, last, radius, label, same)
        if len(i):
            pairs = np.unique(np.stack([label[i], label[j]]), axis=1)
            local = Forest()
            for a, b in pairs.T.tolist():
                local.join(a, b)
                forest.join(names[a], names[b])
            moved = np.arange(n)
            for x in list(local.up):
                moved[x] = local.find(x)
            label = moved[label]
            same = tree.uniform(label)
        first = last


def _link(radius: int, small: int = 24):
    """Runs over rows (key, fp) that are sorted by key."""

    def some(key: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
            link_bucket(np.unique(fp[s : s + n]), radius, forest)
        # A bucket of a few fingerprints is one leaf: all its members are compared at once.
        keep = np.repeat((size > 1) & (size <= small), size)
        key, fp = key[keep], fp[keep]
        for d in range(1, min(small, len(key))):
            hit = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius))
            if len(hit):
                for a, b in np.unique(np.stack([fp[hit], fp[hit + d]]), axis=1).view(np.int64).T.tolist():
                    forest.join(a, b)

    def run(batches):
        forest, held_key, held_fp = Forest(), [], []
        for b in batches:
            key, fp = b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64)
            if not len(key):
                continue
            held_key.append(key)
            held_fp.append(fp)
            if held_key[0][0] != key[-1]:  # all but the last bucket are complete
                key, fp = np.concatenate(held_key), np.concatenate(held_fp)
                cut = int(np.searchsorted(key, key[-1]))
                some(key[:cut], fp[:cut], forest)
                held_key, held_fp = [key[cut:]], [fp[cut:]]
        if held_key:
            some(np.concatenate(held_key), np.concatenate(held_fp), forest)
        a, b = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _cut(mask_bits: list[int], blocks: int) -> list[list[int]]:
    """Deals bit numbers out to blocks."""
    return [mask_bits[k::blocks] for k in range(blocks)]


def _gather(bits: list[int]):
    """The named bits of column fp, packed."""
    runs, out = [], F.lit(0).cast("long")
    for b in bits:
        if runs and runs[-1][0] + runs[-1][1] == b:
            runs[-1][1] += 1
        else:
            runs.append([b, 1])
    at = 0
    for b, n in runs:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << n) - 1).cast("long")), at))
        at += n
    return out


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``nodes``: distinct (fp).  Returns edges (a, b) whose components are those of all links."""
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for a radius of 4")
    edge = np.cumsum((0, *BLOCKS))
    block = [list(range(edge[k], edge[k + 1])) for k in range(len(BLOCKS))]
    levels = [(nodes.withColumn("base", F.lit(0).cast("long")), [sorted(block[i] + block[j]) for i, j in combinations(range(len(BLOCKS)), 2)], [])]
    out = None
    while levels:
        rows, choices, used = levels.pop()
        keyed = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.xxhash64("base", F.lit(k), _gather(bits)).alias("key")) for k, bits in enumerate(choices)])).alias("k")).select("fp", "k.choice", "k.key")
        big = stage(keyed.groupBy("key", "choice").count().filter(F.col("count") > bucket_rows).select(F.col("key").alias("big"), F.col("choice").alias("of")), "big-buckets")
        split = []
        if not big.isEmpty():
            hot = stage(keyed.join(big, (F.col("key") == F.col("big")) & (F.col("choice") == F.col("of"))).drop("big", "of"), "hot-rows")
            keyed = keyed.join(big, F.col("key") == F.col("big"), "left_anti")
            for k, bits in enumerate(choices):
                spent = sorted({*used, *bits})
                rest = [b for b in range(64) if b not in spent]
                if not rest:
                    raise AssertionError("distinct fingerprints can't fill such a bucket")
                split.append((hot.filter(F.col("choice") == k).select("fp", F.col("key").alias("base")), [sorted(x) for x in _cut(rest, 5) if x] if len(rest) >= 5 else [[]], spent))
        found = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_link(radius), "a long, b long")
        out = found if out is None else out.union(found)
        levels += split
    return out


def components(base: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``base``: staged rows with ``fp``, ``doc_id`` and ``h``.  Returns per fingerprint (fp, component_id, stay)
    with the least id and the row that stays of its component."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = stage(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(first).alias("stay")), "nodes")
    group = connected_components(links(nodes.select("fp"), radius, bucket_rows))
    named = nodes.join(group, F.col("fp") == F.col("node"), "left").select("fp", "least", "stay", F.coalesce("component", "fp").alias("component"))
    named = stage(named, "named")
    best = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("stay").alias("stay"))
    return spread_join(named.select("fp", "component"), best, "component", "fp").select("fp", "component_id", "stay")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    base = stage(fingerprints(df, id_col, text_col, width), "fingerprints")
    per_fp = components(base, RADIUS, bucket_rows).withColumnRenamed("fp", "f")
    return base.join(per_fp, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- wide fingerprints, for a similarity instead of a distance -----------------------------------
#: 256 bits; at a Jaccard similarity of 0.8 two texts differ in 15.2 % of them (the angle of 2 J / (1 + J)), which is 38.8 with a
#: standard deviation of 5.7; 4 of 5 shingles differ in 48 with one of 6.2.  The radius leaves out less than one in 10,000 of them.
WIDE_WORDS, WIDE_WIDTH, WIDE_RADIUS, KEY_BITS, KEY_TABLES = 4, 5, 72, 16, 64
#: Pairs whose smaller set has up to so many shingles are candidates by their shingles, too.
SHORT = 64
#: Members of a candidate component that are compared in one piece.
GROUP_ROWS = 2_000


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash from a hash."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = WIDE_WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    found = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _majority(shingles: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    ones, n = np.zeros(64 * words, np.int64), len(shingles)
    for at in range(0, n, 8192):
        bits = np.stack([_remix(shingles[at : at + 8192], k) for k in range(words)], axis=1)
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64) if n else np.zeros(words, np.uint64)


def wide_fingerprint(text: str, width: int = WIDE_WIDTH, words: int = WIDE_WORDS) -> np.ndarray:
    """``words`` times 64 bits; each bit by the majority of the distinct shingles."""
    return _majority(shingle_set(text, width), words)


def least_fifth(shingles: np.ndarray) -> np.ndarray:
    """Of two sets with a similarity of 0.8 or more, these parts have a shingle in common.  Nothing for large sets."""
    n = len(shingles)
    return shingles[: n - (4 * n + 4) // 5 + 1] if n <= SHORT * 5 // 4 else shingles[:0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ordered sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 5 * common >= 4 * (len(both) - common)


class WideTree:
    """The Gray-order tree over fingerprints of several words (rows of a matrix); the first word orders them."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.values, self.fanout = values, fanout
        both = [(values, values)]
        while len(both[-1][0]) > fanout:
            at = np.arange(0, len(both[-1][0]), fanout)
            both.append((np.bitwise_and.reduceat(both[-1][0], at, axis=0), np.bitwise_or.reduceat(both[-1][1], at, axis=0)))
        self.levels, above = [], None
        for low, high in reversed(both):
            mask = ~(low ^ high)
            self.levels.append((low, mask if above is None else mask & ~np.repeat(above, fanout, axis=0)[: len(mask)]))
            above = mask

    uniform = GrayTree.uniform

    def search(self, first: int, last: int, radius: int, label: np.ndarray, same: list[np.ndarray]):
        """As in ``GrayTree``."""
        f, top = self.fanout, len(self.levels[0][0])
        who, node = np.repeat(np.arange(first, last), top), np.tile(np.arange(top), last - first)
        total, span = np.zeros(len(who), np.int64), f ** (len(self.levels) - 1)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                who, total = np.repeat(who, f), np.repeat(total, f)
                node = (node[:, None] * f + np.arange(f)).ravel()
            keep = node < len(pattern)
            who, node, total = who[keep], node[keep], total[keep]
            keep = ((node + 1) * span - 1 > who) & (same[depth][node] != label[who])
            who, node, total = who[keep], node[keep], total[keep]
            total = total + np.bitwise_count((self.values[who] ^ pattern[node]) & own[node]).sum(1, dtype=np.int64)
            keep = total <= radius
            who, node, total = who[keep], node[keep], total[keep]
            span //= f
        return who, node


def link_wide_bucket(names: np.ndarray, values: np.ndarray, radius: int, forest: Forest) -> None:
    """Adds the components of one bucket: distinct ``names`` with their fingerprints."""
    order = np.argsort(gray_rank(values[:, 0]), kind="stable")
    values, name = values[order], names[order].tolist()
    tree, n = WideTree(values), len(values)
    label = np.unique([forest.find(x) for x in name], return_inverse=True)[1]
    same, first = tree.uniform(label), 0
    while first < n - 1:
        last = min(n - 1, first + max(1, min(64, 500_000 // n)))
        i, j = tree.search(first, last, radius, label, same)
        if len(i):
            for k in np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)[1].tolist():
                forest.join(name[i[k]], name[j[k]])
            label = np.unique([forest.find(x) for x in name], return_inverse=True)[1]
            same = tree.uniform(label)
        first = last


def _wide_link(radius: int, words: int, small: int = 16):
    """Runs over rows (key, node, fp) that are sorted by key; ``fp`` is binary."""

    def some(key: np.ndarray, node: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
            one, at = np.unique(node[s : s + n], return_index=True)
            link_wide_bucket(one, fp[s : s + n][at], radius, forest)
        keep = np.repeat((size > 1) & (size <= small), size)
        key, node, fp = key[keep], node[keep], fp[keep]
        for d in range(1, min(small, len(key))):
            hit = np.flatnonzero(key[d:] == key[:-d])
            hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + d]).sum(1, dtype=np.int64) <= radius]
            if len(hit):
                for a, b in np.unique(np.stack([node[hit], node[hit + d]]), axis=1).T.tolist():
                    forest.join(a, b)

    def run(batches):
        forest, held = Forest(), []
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b["fp"].to_pylist()), np.uint64).reshape(-1, words)
            held.append((b["key"].to_numpy(), b["node"].to_numpy(), fp))
            if held[0][0][0] != held[-1][0][-1]:
                key, node, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))
                some(key[:cut], node[:cut], fp[:cut], forest)
                held = [(key[cut:], node[cut:], fp[cut:])]
        if held:
            some(*(np.concatenate(x) for x in zip(*held)), forest)
        a, b = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def wide_key_bits(words: int = WIDE_WORDS, bits: int = KEY_BITS, tables: int = KEY_TABLES) -> list[list[int]]:
    """The bits of each table's key: the fingerprint dealt into disjoint keys, again and again in other orders."""
    out: list[list[int]] = []
    total, turn = 64 * words, 0
    while len(out) < tables:
        order = sorted(range(total), key=lambda b: xxhash.xxh64_intdigest(f"{turn}:{b}", 5))
        out += [order[k : k + bits] for k in range(0, total - bits + 1, bits)]
        turn += 1
    return out[:tables]


def similar_links(nodes: DataFrame, radius: int = WIDE_RADIUS, words: int = WIDE_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``nodes``: (node long, fp binary, part binary: shingles that serve as keys), distinct.  Edges between fingerprints that share one of the keys and differ
    in at most ``radius`` bits.  The rows of a key above ``bucket_rows`` are dealt by further keys first, which finds most groups;
    then blocks of the rows meet each other, so that no two rows of the key in different groups go uncompared."""

    def keyed(depth: int):
        tables = wide_key_bits(words, KEY_BITS, KEY_TABLES * (depth + 1))[KEY_TABLES * depth :]

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                raw = b["fp"].to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
                base = b["base"].to_numpy()
                for k, t in enumerate(tables):
                    value = np.packbits(bits[:, t], axis=1).astype(np.uint64) @ (np.uint64(1) << (np.uint64(8) * np.arange((len(t) + 7) // 8, dtype=np.uint64)))
                    key = _remix(base.view(np.uint64) ^ (value + np.uint64((k + 1) << 32)), depth).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b["node"], b["fp"]], ["key", "node", "fp"])
                parts = b["part"].to_pylist()
                of = pa.array(np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts]))
                key = _remix(np.frombuffer(b"".join(parts), np.uint64) ^ base.view(np.uint64)[of.to_numpy()], 64 + depth).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b["node"].take(of), b["fp"].take(of)], ["key", "node", "fp"])

        return run

    rows, depth, out, hot = nodes.select("node", "fp", "part", F.lit(0).cast("long").alias("base")), 0, None, None
    while True:
        each = rows.mapInArrow(keyed(depth), "key long, node long, fp binary")
        big = stage(each.groupBy("key").count().filter(F.col("count") > bucket_rows).select(F.col("key").alias("big")), "big-buckets")
        none = big.isEmpty()
        fit = each if none else each.join(big, F.col("key") == F.col("big"), "left_anti")
        found = fit.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_link(radius, words), "a long, b long")
        out = found if out is None else out.union(found)
        if none or depth == 2:  # what is left is met by blocks
            break
        rows, depth = stage(each.join(big, F.col("key") == F.col("big")).select("node", "fp", F.lit(b"").alias("part"), F.col("key").alias("base")), "hot-rows"), depth + 1
        hot = rows if hot is None else hot
    if hot is None:
        return out
    equal = hot.groupBy(F.col("fp").alias("e_fp")).agg(F.min("node").alias("b"))  # any number of sets can have one fingerprint
    out = stage(out.union(hot.join(equal, F.col("fp") == F.col("e_fp")).select(F.col("node").alias("a"), "b")), "links")
    group = connected_components(out).select(F.col("node").alias("g_node"), "component")
    met = hot.join(group, F.col("node") == F.col("g_node"), "left").select(F.col("base").alias("key"), "node", F.coalesce("component", "node").alias("label"), "fp")
    dealt = deal(stage(met, "hot-labels"), bucket_rows)
    return out.union(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_link(radius, words), "a long, b long"))


def _held(batches, names: list[str], work):
    """Calls ``work`` with the columns ``names`` of all rows of a key, one key after another; rows are sorted by key."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:]):
            if held and held[0]["key"][0].as_py() != key[s]:
                work(*([x for h in held for x in h[n].to_pylist()] for n in names))
                held = []
            held.append(b.slice(s, e - s))
    if held:
        work(*([x for h in held for x in h[n].to_pylist()] for n in names))


def link_sets(names: np.ndarray, values: np.ndarray, sets: list[np.ndarray], label: np.ndarray, radius: int, forest: Forest) -> None:
    """Adds the links of some members of a candidate component; pairs with one ``label`` are in one group already."""
    order = np.argsort(gray_rank(values[:, 0]), kind="stable")
    values, name, sets, given = values[order], names[order].tolist(), [sets[k] for k in order.tolist()], label[order]
    tree, n, first = WideTree(values), len(values), 0
    own = Forest()

    def relabel():
        label = np.array([own.find(x) for x in given.tolist()])
        return np.unique(label, return_inverse=True)[1]

    label = relabel()
    same = tree.uniform(label)
    while first < n - 1:
        last = min(n - 1, first + max(1, min(64, 500_000 // n)))
        i, j = tree.search(first, last, radius, label, same)
        far, found = np.bitwise_count(values[i] ^ values[j]).sum(1, dtype=np.int64), False
        for k in np.argsort(far, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            x, y = int(given[a]), int(given[b])
            if own.find(x) != own.find(y) and similar(sets[a], sets[b]):
                own.join(x, y)
                forest.join(name[a], name[b])
                found = True
        if found:
            label = relabel()
            same = tree.uniform(label)
        first = last


def _edges(forest: Forest) -> pa.RecordBatch:
    a, b = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(radius: int, words: int):
    """Runs over rows (key, node, label, fp, shingles) that are sorted by key."""

    def run(batches):
        forest = Forest()

        def work(node, label, fp, shingles):
            if len(node) > 1:
                values = np.frombuffer(b"".join(fp), np.uint64).reshape(-1, words)
                link_sets(np.array(node), values, [np.frombuffer(x, np.uint64) for x in shingles], np.array(label), radius, forest)

        _held(batches, ["node", "label", "fp", "shingles"], work)
        yield _edges(forest)

    return run


def _chain(batches):
    """Links between neighbours of large components; rows (key, node, fp, shingles) are sorted by key and fp."""
    forest, last = Forest(), []
    for b in batches:
        for key, node, s in zip(b["key"].to_pylist(), b["node"].to_pylist(), b["shingles"].to_pylist()):
            s = np.frombuffer(s, np.uint64)
            last = [x for x in last if x[0] == key][-3:]
            for _, other, t in last:
                if forest.find(node) != forest.find(other) and similar(s, t):
                    forest.join(node, other)
            last.append((key, node, s))
    yield _edges(forest)


def deal(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, node, label, ...) with keys of at most about ``most`` rows each, so that any two rows of a key with different
    labels meet in a new key.  Larger keys are cut into blocks and each block meets each other one; blocks of one label don't meet."""
    size = rows.groupBy("key", "label").count()
    keys = size.groupBy(F.col("key").alias("big")).agg(F.sum("count").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("n") > most)
    keys = stage(keys, "big-buckets")
    if keys.isEmpty():
        return rows
    half = max(1, most // 2)
    mixed = keys.filter("lo <> hi")
    of = F.when(F.col("count") > half, F.struct(F.lit(True).alias("own"), F.col("label").alias("name"))).otherwise(F.struct(F.lit(False).alias("own"), F.lit(0).cast("long").alias("name")))
    size = size.join(mixed, F.col("key") == F.col("big"), "left_semi").withColumn("of", of)
    blocks = stage(size.groupBy("key", "of").agg(F.ceil(F.sum("count") / half).cast("int").alias("m")), "blocks")
    block = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"), "of").select("key", F.struct("of", "p").alias("x"))
    meet = block.join(block.select(F.col("key").alias("k"), F.col("x").alias("y")), (F.col("key") == F.col("k")) & (F.col("x") <= F.col("y")))
    meet = meet.filter(~(F.col("x.of.own") & (F.col("x.of") == F.col("y.of"))))
    side = meet.select("key", F.xxhash64("key", "x", "y").alias("to"), F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).select(F.col("key").alias("s_key"), F.col("x.of").alias("s_of"), F.col("x.p").alias("s_p"), "to")
    own = size.filter("of.own").select(F.col("key").alias("o_key"), F.col("label").alias("o_label"))
    hot = rows.join(mixed, F.col("key") == F.col("big"), "left_semi").join(own, (F.col("key") == F.col("o_key")) & (F.col("label") == F.col("o_label")), "left")
    name = F.struct(F.col("o_key").isNotNull().alias("own"), F.coalesce("o_label", F.lit(0).cast("long")).alias("name"))
    hot = hot.select(*rows.columns, name.alias("is_of")).join(blocks.select(F.col("key").alias("b_key"), F.col("of").alias("b_of"), "m"), (F.col("key") == F.col("b_key")) & (F.col("is_of") == F.col("b_of")))
    hot = hot.withColumn("at", F.expr("cast(pmod(xxhash64(node, 7), m) as int)"))
    dealt = hot.join(side, (F.col("key") == F.col("s_key")) & (F.col("is_of") == F.col("s_of")) & (F.col("at") == F.col("s_p")))
    fit = rows.join(keys, F.col("key") == F.col("big"), "left_anti")
    return fit.union(dealt.select(F.col("to").alias("key"), *rows.columns[1:]))


def exact_links(members: DataFrame, radius: int = WIDE_RADIUS, words: int = WIDE_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``members``: staged (key: candidate component, node, fp, shingles).  Edges whose components are those of all pairs of a
    candidate component with a similarity of 0.8 or more.  In a component above ``group_rows`` neighbours in order of their
    fingerprints are linked first; what is in one group then isn't compared again."""
    big = stage(members.groupBy("key").count().filter(F.col("count") > group_rows).select(F.col("key").alias("big")), "big-groups")
    rows, first = members.withColumn("label", F.col("node")), None
    if not big.isEmpty():
        large = members.join(big, F.col("key") == F.col("big"), "left_semi").select("key", "node", "fp", "shingles")
        first = stage(large.repartition("key", F.substring("fp", 1, 1)).sortWithinPartitions("key", "fp").mapInArrow(_chain, "a long, b long"), "chains")
        group = connected_components(first).select(F.col("node").alias("g_node"), "component")
        rows = stage(members.join(group, F.col("node") == F.col("g_node"), "left").withColumn("label", F.coalesce("component", "node")), "labels")
    dealt = deal(rows.select("key", "node", "label", "fp", "shingles"), group_rows)
    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(radius, words), "a long, b long")
    return found if first is None else found.union(first)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE_WIDTH, radius: int = WIDE_RADIUS, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``df`` that stay: of each component of similar texts (five-word shingles, Jaccard similarity of 0.8 or more)
    the one with the least id."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b["text"].to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fp, part = [_majority(s).tobytes() for s in sets], [least_fifth(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(node), pa.array(fp, pa.binary()), pa.array(part, pa.binary()), b["h"]], ["doc_id", "node", "fp", "part", "h"])

    def shingled(batches):
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], b["node"], b["fp"], pa.array(sets, pa.binary())], ["key", "node", "fp", "shingles"])

    text = text_of(df[text_col])
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    base = stage(docs.mapInArrow(run, "doc_id long, node long, fp binary, part binary, h long"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = stage(base.groupBy("node").agg(F.first("fp").alias("fp"), F.first("part").alias("part"), F.min(first).alias("stay")), "nodes")
    near = connected_components(similar_links(nodes.select("node", "fp", "part"), radius, WIDE_WORDS, bucket_rows)).select(F.col("node").alias("n"), "component")
    heads = near.select("component").distinct().select(F.col("component").alias("n"), "component")
    members = nodes.join(near.union(heads).distinct(), F.col("node") == F.col("n")).select(F.col("component").alias("key"), "node", "fp", F.col("stay.doc_id").alias("m_id"), F.col("stay.h").alias("m_h"))
    # one text of each member; rows that repeat an id and a text are equal in it
    met = docs.join(stage(members, "members"), (F.col("h") == F.col("m_h")) & F.col("doc_id").eqNullSafe(F.col("m_id"))).select("key", "node", "fp", "text")
    sets = stage(met.mapInArrow(shingled, "key long, node long, fp binary, shingles binary").dropDuplicates(["node"]), "shingles")
    group = connected_components(exact_links(sets, radius, WIDE_WORDS, group_rows)).withColumnRenamed("node", "n")
    named = nodes.join(group, F.col("node") == F.col("n"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("stay").alias("stay"))

    def row_keys(row_id, h):
        # plain equalities, so that the join's partitioning serves the aggregation behind it
        return [h, F.coalesce(row_id, F.lit(0).cast("long")), row_id.isNull()]

    own, other = ["__h", "__id", "__none"], ["__stay_h", "__stay_id", "__stay_none"]
    stay = stage(named.select(*[c.alias(n) for c, n in zip(row_keys(F.col("stay.doc_id"), F.col("stay.h")), other)]), "stay")
    names = [f"c{i}" for i in range(len(df.columns))]
    keys = row_keys(df[id_col].cast("long"), F.xxhash64(text_of(df[text_col])))
    rows = df.select(*[c.alias(n) for c, n in zip(keys, own)], F.struct(*[df[c].alias(n) for c, n in zip(df.columns, names)]).alias("row"))
    kept = rows.join(stay, [F.col(a) == F.col(b) for a, b in zip(own, other)], "left_semi")
    one = kept.groupBy(*own).agg(F.first("row").alias("row"))
    return one.select(*[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names)])
