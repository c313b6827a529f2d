import hashlib

import numpy as np
import pytest

from lexmill.llm import substring_dedup as D


def brute(rows, window):
    docs = [(i if i is not None else 1 << 70, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            s = tuple(w[p : p + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_gram_hashes_agree():
    h = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    h[200:250] = h[20:70]
    for n in (1, 2, 3, 10, 31, 50):
        g = D.gram_hashes(h, n)
        assert len(g) == 300 - n + 1 and len(set(g.tolist())) == 300 - n + 1 - (50 - n + 1)
        assert (g[200 : 250 - n + 1] == g[20 : 70 - n + 1]).all()


def test_suffix_tree():
    r = np.random.default_rng(4)
    segments = [[b"abc"[k : k + 1] for k in r.integers(0, 3, int(n))] for n in r.integers(0, 12, 12)] + [[b"x"] * 300, [b"x"] * 140]
    tree = D.SuffixTree(segments, 3)
    suffixes = [segments[s][p:] for s, p in zip(tree.segment, tree.place)]
    assert len(suffixes) == sum(max(0, len(s) - 2) for s in segments)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert tree.shared[k] == min(127, common)
    node = tree.nodes(3)
    for i in range(0, len(suffixes), 7):
        for j in range(0, len(suffixes), 5):
            assert (node[i] == node[j]) == (suffixes[i][:3] == suffixes[j][:3])


def test_maximal_repeats():
    r = np.random.default_rng(9)
    segments = [[b"ab"[k : k + 1] for k in r.integers(0, 2, 25)] for _ in range(3)]
    got = {b"".join(w): n for w, n in D.maximal_repeats(segments, 4)}
    spots = {}
    for s, x in enumerate(segments):
        for i in range(len(x)):
            for j in range(i + 4, len(x) + 1):
                spots.setdefault(b"".join(x[i:j]), []).append((s, i, j))
    want = {}
    for w, at in spots.items():
        before = {segments[s][i - 1] if i else (s, "start") for s, i, _ in at}
        after = {segments[s][j] if j < 25 else (s, "end") for s, _, j in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want[w] = len(at)
    assert got == want and len(want) > 5


def corpus(seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [vocabulary[i] for i in r.integers(0, 400, n)]
    passages = [text(70), text(50), text(49), text(200)]
    docs = []
    for k in range(60):
        w = text(int(r.integers(0, 120)))
        for _ in range(int(r.integers(0, 3))):
            at = int(r.integers(0, len(w) + 1))
            w = w[:at] + passages[int(r.integers(0, 4))] + w[at:]
        docs.append(w)
    docs += [docs[3], docs[3], ["same"] * 300, ["same"] * 120, ["same", "other"] * 60, docs[5][:40] + ["edit"] + docs[5][40:]]
    order = r.permutation(len(docs))
    return [(int(order[k]) * 7, " \n".join(w)) for k, w in enumerate(docs)]


@pytest.mark.parametrize("seed,group_rows", [(1, 2000), (2, 3), (3, 1)])
def test_matches_brute_force(spark, seed, group_rows):
    rows = corpus(seed) + [(9001, None), (9003, ""), (None, "x " * 60), (None, "x " * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id if x.doc_id is not None else 1 << 70, x.n_words, x.n_removed, x.kept_sha256) for x in D.remove_repeats(df, group_rows=group_rows).collect())
    assert got == brute(rows, 50)
    assert sum(x[2] for x in got) > 1000
    assert not group_rows < 9 or D.remove_repeats(df, group_rows=group_rows).filter("n_removed > 0").count() > 5
    whole = D.remove_repeats(df, group_rows=group_rows, texts=True).collect()
    assert got == sorted((x.doc_id if x.doc_id is not None else 1 << 70, x.n_words, x.n_removed, x.kept_sha256) for x in whole)
    for x in whole:
        assert hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 and x.n_removed == sum(s["last"] - s["first"] + 1 for s in x.removed)


def test_hot_window_and_very_long_text(spark):
    r = np.random.default_rng(7)
    text = lambda n: " ".join(f"v{i}" for i in r.integers(0, 3000, n))
    hot, copy = text(64), text(90)
    rows = [(i, f"{text(30)} {hot} {text(20)}") for i in range(0, 240, 2)] + [(i, copy) for i in range(1, 160, 2)]
    rows += [(500, f"{text(60_000)} {hot}"), (501, " ".join([text(200)] * 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for group_rows in (20, 1000):
        got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in D.remove_repeats(df, group_rows=group_rows).collect())
        assert got == brute(rows, 50)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 40, 1, "x"), (1, "a b " * 40, 1, "x"), (2, "a b " * 40, 2, "y")], "doc_id long, text string, did int, th string")
    got = sorted((x.doc_id, x.n_removed) for x in D.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 80)]
    assert D.remove_repeats(df.limit(0)).count() == 0
