import numpy as np
import pytest

from lexmill.llm import quality as Q


def corpus(n=600, seed=0):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefghilmnoprstu"), int(k))) for k in r.integers(2, 9, 500)]
    prose = lambda n: " ".join((w.title() if k % 11 == 0 else w + "." if k % 11 == 10 else w) for k, w in enumerate(r.choice(vocabulary, n)))
    rows = []
    for k in range(n):
        t, kind = prose(int(r.integers(30, 300))), k % 8
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 1:
            t = " ".join(w + "&$#*"[i % 4] * 3 for i, w in enumerate(t.split()))
        elif kind == 2:
            t = " ".join(x for w in t.split()[:40] for x in [w] * 9)
        rows.append((k, t, int(kind > 2)))
    return rows


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    n, bad = 20_000, r.random(20_000) < 0.2
    rates = [(0.95, 0.02), (0.7, 0.05), (0.5, 0.01), (0.8, 0.2)]
    votes = np.zeros((n, len(rates)), int)
    for k, (hit, false) in enumerate(rates):
        says_bad = np.where(bad, r.random(n) < hit, r.random(n) < false)
        votes[:, k] = np.where(r.random(n) < 0.15, Q.ABSTAIN, np.where(says_bad, Q.BAD, Q.GOOD))
    pattern, count = np.unique((votes * 3 ** np.arange(4)).sum(1), return_counts=True)
    m = Q.fit_label_model(pattern, count, labellers=4)
    assert abs(m.prior_bad - 0.2) < 0.03
    for k, (hit, false) in enumerate(rates):
        assert abs(m.rates[k, 1, Q.BAD] - hit) < 0.05 and abs(m.rates[k, 0, Q.BAD] - false) < 0.05
    assert np.allclose(m.posterior_bad(pattern), Q.fit_label_model(pattern[::-1], count[::-1], 4).posterior_bad(pattern))


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in Q.score(df, train_rows=300).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].keep == bool(q) for i, _, q in rows) / len(rows)
    lost = sum(not got[i].keep for i, _, q in rows if q)
    assert right > 0.98 and lost == 0
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in Q.score(df.repartition(3), train_rows=300).collect()}


def test_keep_good(spark):
    rows = corpus(200)
    df = spark.createDataFrame([(None if i == 5 else i, t, "x", i) for i, t, _ in rows] + [(900, None, None, None), (901, "", "y", 1)], "doc_id long, text string, votes string, keep int")
    out = Q.keep_good(df)
    assert out.schema == df.schema
    kept = {r["keep"] for r in out.filter("doc_id is null or doc_id < 900").collect()}
    scored = {r.doc_id: r.keep for r in Q.score(df).collect()}
    assert kept == {i for i, _, _ in rows if scored[None if i == 5 else i]}
    assert out.filter("doc_id >= 900").count() == 0
    assert Q.keep_good(df.limit(0)).count() == 0 and Q.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("word,want", [("Word", "Aa"), ("word,", "a,"), ("WORD!!", "AA!!"), ("W", "A"), ("ab12", "a9"), ("x&&&", "a&&&"), ("|", "|")])
def test_shape(word, want):
    assert Q.shape(word) == want


def test_very_long_text_and_clashing_names(spark):
    rows = [(1, "Plain words make a text. " * 20_000, 1, "x", None), (2, "!!! ### " * 9, 2, "y", "z"), (2, "!!! ### " * 9, 2, "y", "z"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes int, k0 string, dims string")
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {1, 2}
    assert sorted(r.doc_id or 0 for r in Q.score(df).collect()) == [0, 1, 2, 2]
