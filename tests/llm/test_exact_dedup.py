import hashlib
import re

import pytest

from lexmill.llm import exact_dedup as E


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = groups[key(t)]
        best = min(g)
        keep = None if best[1] else best[2]
        out.append((i, keep, len(g), hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(k, f"text {k % 7}") for k in range(200)] + [(k + 300, "same  text" + " " * (k % 5)) for k in range(150)] + [(900, None), (901, ""), (902, " \n\x0b"), (903, "a\xa0b"), (904, "ab"), (905, "x y")]


@pytest.mark.parametrize("support", [0.001, 0.05, 0.9])
def test_assign(spark, support):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = E.assign(df, support=support).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("support", [0.001, 0.05, 0.9])
def test_dedup(spark, support):
    df = spark.createDataFrame([(i, t, "s", k, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, digest string, ord int, c0 int").repartition(5)
    got = E.dedup(df, support=support)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({k for _, k, *_ in brute(ROWS)})


def test_odd_rows(spark):
    rows = [(None, "a"), (None, "a "), (1, "b"), (1, "b"), (1, "c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.assign(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    assert sorted((r.text or "") for r in E.dedup(df).collect()) == ["", "a ", "b", "c"]
    assert E.assign(df.limit(0)).count() == 0 and E.dedup(df.limit(0)).count() == 0


def test_native(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for out in (E.assign(df), E.dedup(df)):
        assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
