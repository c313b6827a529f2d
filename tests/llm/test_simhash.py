import numpy as np
import pytest
import xxhash

from lexmill.llm import simhash as S


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One TWO three", "a b c d", "É a b c d a b c d a b c d", "x\xa0y z\x0bw q " * 40])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("seed,n,flip", [(0, 400, 3), (1, 1500, 6), (2, 60, 2)])
def test_bucket_matches_brute_force(seed, n, flip):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, max(2, n // 40), dtype=np.uint64)
    v = base[r.integers(0, len(base), n)]
    for _ in range(flip):
        v = v ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    v = np.unique(v)
    forest = S.Forest()
    S.link_bucket(v, 4, forest)
    want = slow_components(v.tolist())
    names = v.view(np.int64).tolist()
    got = {x: forest.find(x) for x in names}
    groups = lambda label: {frozenset(i for i in range(len(v)) if label[i] == c) for c in set(label)}
    assert groups([got[x] for x in names]) == groups(want)


@pytest.mark.parametrize("bucket_rows", [20_000, 5])
def test_components(spark, bucket_rows):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for k in range(40):
        t = [words[i] for i in r.integers(0, 60, 80)]
        for c in range(4):
            u = list(t)
            for _ in range(c):
                u[int(r.integers(0, 80))] = "edit"
            texts.append(" ".join(u))
    texts += [None, "", " \t", "short", "SHORT", texts[0]]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {x.doc_id: x for x in S.near_components(df, bucket_rows=bucket_rows).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i * 3].fingerprint == f"{fps[i]:016x}"
        assert got[i * 3].component_id == want[i] * 3


def test_odd_rows(spark):
    schema = "doc_id long, text string, row string, c0 int"
    rows = [(None, "a b c d e f", "p", 1), (1, "a b c d e f", "q", None), (1, "a b c d e f", "q", None), (None, None, None, 2), (5, "quite another text than that one", "z", 3)]
    df = spark.createDataFrame(rows, schema)
    out = S.near_components(df).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.component_id) for x in out if x.component_id is not None) == [(False, 1, 1), (False, 1, 1), (False, 5, 5), (True, 0, 1)]
    kept = S.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id is None, x.text or "") for x in kept.collect()) == [(False, "a b c d e f"), (False, "quite another text than that one"), (True, "")]
    assert S.near_dedup(df.limit(0)).count() == 0 and S.near_components(df.limit(0)).count() == 0


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize("n", [300, 17])
def test_wide_bucket_matches_brute_force(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 2**63, (6, 4), dtype=np.uint64)
    v = base[r.integers(0, 6, n)]
    for _ in range(22):
        v[np.arange(n), r.integers(0, 4, n)] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    forest, names = S.Forest(), np.arange(100, 100 + n)
    S.link_wide_bucket(names, v, 38, forest)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if int(np.bitwise_count(v[i] ^ v[j]).sum()) <= 38:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert [forest.find(100 + i) - 100 for i in range(n)] == [find(i) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_near_dedup_follows_similarity(spark, bucket_rows):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    rows, near, far = [], 0, 0
    for k in range(120):
        t = [words[i] for i in r.integers(0, 3000, int(r.integers(150, 500)))]
        u = list(t)
        for at in r.integers(0, len(u), max(1, len(u) // 100) if k % 2 else len(u) // 8):
            u[int(at)] = "edit"
        j = jaccard(" ".join(t), " ".join(u))
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
        near, far = near + (j > 0.88), far + (j < 0.65)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in S.near_dedup(df, bucket_rows=bucket_rows).collect()}
    assert all(2 * k in kept for k in range(120))
    text = dict(rows)
    missed = sum(2 * k + 1 in kept for k in range(120) if jaccard(text[2 * k], text[2 * k + 1]) > 0.88)
    wrong = sum(2 * k + 1 not in kept for k in range(120) if jaccard(text[2 * k], text[2 * k + 1]) < 0.65)
    assert near >= 30 and far >= 30 and missed <= 0.03 * near and wrong <= 0.03 * far


def exact_groups(texts):
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def repeated_and_short():
    r = np.random.default_rng(5)
    word = lambda n: [f"v{i}" for i in r.integers(0, 10**6, n)]
    block, texts = word(14), []
    for _ in range(12):  # different texts that repeat one block: similarity below 0.1
        texts.append(" ".join(x for _ in range(20) for x in [*block, "|"]) + " " + " ".join(word(154)))
    for _ in range(25):  # 4 of 5 shingles
        t = word(9)
        texts += [" ".join(t), " ".join(t[:8])]
    for k in range(40):  # template with edits: similarities on both sides of 0.8
        t = word(200)
        texts.append(" ".join(t))
        for c in range(1, 5):
            u = list(t)
            for at in r.choice(200, c + k % 4, replace=False):
                u[at] = "edit"
            texts.append(" ".join(u))
    return texts


@pytest.mark.parametrize("group_rows", [2_000, 4])
def test_near_dedup_decides_on_shingle_sets(spark, group_rows):
    texts = repeated_and_short()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in S.near_dedup(df, group_rows=group_rows).collect()}
    want = {k for k, c in enumerate(exact_groups(texts)) if k == c}
    assert set(range(12)) <= kept
    assert not {k for k in range(12, 62) if (k in kept) != (k in want)}
    assert len(kept ^ want) <= 3  # keys of longer texts miss some pairs near 0.8
    assert want <= kept


def test_large_buckets_are_searched_whole(spark):
    r = np.random.default_rng(8)
    key = S.wide_key_bits()[0]
    bits = r.integers(0, 2, (60, 256)).astype(np.uint8)
    bits[:, key] = bits[0, key]  # all share this key
    twin = bits.copy()
    rest = [b for b in range(256) if b not in key]
    for row in twin:
        row[r.choice(rest, 70, replace=False)] ^= 1
    fp = np.packbits(np.concatenate([bits, twin]), axis=1, bitorder="little")
    df = spark.createDataFrame([(k, bytearray(f.tobytes()), bytearray()) for k, f in enumerate(fp)], "node long, fp binary, part binary").repartition(3)
    groups = [{(x.node, x.component) for x in S.connected_components(S.similar_links(df, bucket_rows=n)).collect()} for n in (20_000, 10)]
    assert groups[0] == groups[1] and len(groups[0]) >= 60
