import hashlib
import re

import xxhash

from lexmill.llm import minhash as M

MASK = (1 << 64) - 1


def chain(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def slow_fingerprint(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = {chain(words[i : i + 5]) for i in range(len(words) - 4)} or {chain([b" ".join(words)])}
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    bins = {}
    for x in signed:
        b = (x >> M._SHIFT) + M.BINS // 2
        bins[b] = min(bins.get(b, x), x)
    out = []
    for b in range(M.BINS):
        look = [b] + [(x - (1 << 64) if x >> 63 else x) % M.BINS for x in (chain([b.to_bytes(4, "little"), t.to_bytes(4, "little")]) for t in range(M.PROBES))]
        hit = next((bins[x] for x in look if x in bins), None)
        if hit is None:
            def priority(j):
                x = chain([b.to_bytes(4, "little")])
                x = xxhash.xxh64_intdigest(int(j).to_bytes(8, "little"), x)
                return x - (1 << 64) if x >> 63 else x
            hit = bins[min(bins, key=lambda j: (priority(j), bins[j]))]
        out.append(f"{hit & 15:x}")
    return "".join(out)


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def texts():
    import numpy as np

    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = [" ".join(vocabulary[i] for i in r.integers(0, 2000, int(n))) for n in r.integers(1, 1500, 30)]
    near = out[3].split()
    near[10] = "changed"
    return [*out, " ".join(near), out[4], "", " ", "one two", "ünï cödé text of five words\nand more"]


def test_matches_brute_force(spark):
    rows = [(i * 11 % 97, t, "fp") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(6)
    got = {x.doc_id: x for x in M.edited_next(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: -x[0])
    error = []
    for k, (i, t, _) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == slow_fingerprint(t)
        assert x.edited_fingerprint == slow_fingerprint(edited)
        error.append(x.near_edited - jaccard(t, edited))
        error.append(x.near_next - jaccard(t, nxt))
    assert max(map(abs, error)) < 0.15 and abs(sum(error) / len(error)) < 0.02


def test_likeness_is_unbiased(spark):
    a = "w" + " w".join(map(str, range(3000)))
    rows = [(k, a, "w" + " w".join(map(str, range(k * 250, 3000 + k * 250)))) for k in range(10)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    from pyspark.sql import functions as F

    got = df.select("k", M.likeness(M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))).alias("j")).collect()
    assert max(abs(x.j - jaccard(rows[x.k][1], rows[x.k][2])) for x in got) < 0.09


def test_odd_rows(spark):
    schema = "doc_id long, text string, self_id int, m string"
    rows = [(None, "a b c d e f g h i", 1, "x"), (4, "p q r s t u v", 2, "y"), (4, "p q r s t u v", 2, "y"), (9, None, 3, None)]
    df = spark.createDataFrame(rows, schema)
    got = M.edited_next(df).collect()
    assert len(got) == 4
    assert {x.edited_sha256 for x in got if x.doc_id == 4} == {hashlib.sha256(b"p q r s ta b ").hexdigest()}
    assert M.edited_next(df.limit(1)).count() == 1 and M.edited_next(df.limit(0)).count() == 0
    one = M.edited_next(df.limit(1)).first()
    assert one.near_next == 1.0
