import hashlib
import math
from collections import Counter

import pytest

from lexmill.llm import mixing as M


def slow_targets(sizes):
    """The excess is shared again by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    rest, free = 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        over = 0.0
        for s in list(free):
            got[s] += rest * weight[s] / total
            if got[s] >= 2 * sizes[s]:
                over += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                free.discard(s)
        rest = over
    return got


def slow_mix(rows):
    size = {k: len((t or "").split()) for k, (_, t, _) in enumerate(rows)}
    sizes = Counter()
    for k, (_, _, s) in enumerate(rows):
        sizes[s] += size[k]
    target = slow_targets(sizes)
    key = {}
    for k, (i, t, _) in enumerate(rows):
        x = int(hashlib.md5(f"{M.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
        n = len(t or "")
        w = 0.05 if not n else max(0.05, 1 - sum(c in M.SYMBOLS for c in t) / n)
        key[k] = -math.log((x + 0.5) / (1 << 52)) / w
    out = []
    for s in sizes:
        own = sorted((k for k in size if rows[k][2] == s), key=lambda k: (key[k], rows[k][0] or -1, size[k]))
        epochs = int(target[s] // sizes[s] + 1e-12) if sizes[s] else 0
        rest, before = target[s] - epochs * sizes[s], 0
        for k in own:
            more = before + size[k] / 2 <= rest and size[k] > 0
            before += size[k]
            out.append((rows[k][0], size[k], sizes[s], round(target[s], 6), size[k] * (epochs + more)))
    return sorted(out, key=str)


def rows(n=400):
    text = lambda k: " ".join(["w"] * ((k * 37) % 90 + 1)) + " #" * (k % 4)
    return [(k, text(k), None if k % 29 == 0 else "hot" if k % 3 else f"s{k % 11}") for k in range(n)] + [(n, None, "hot"), (n + 1, "", "empty"), (n + 2, "word " * 3000, "é")]


@pytest.mark.parametrize("per_bucket", [10_000, 20])
def test_matches_brute_force(spark, per_bucket):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, source string, size int").repartition(4)
    got = M.mix(df, rows_per_bin=per_bucket).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == slow_mix(rows())
    taken, biggest, target = Counter(), Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6 for s in target)
    assert got == M.mix(df, rows_per_bin=per_bucket).collect() or sorted(map(str, got)) == sorted(map(str, M.mix(df, rows_per_bin=per_bucket).collect()))


def test_mixed_rows(spark):
    base = [*rows(60), (7, "twice twice", "s7"), (7, "twice twice", "s7"), (None, "no id", "s7")]
    df = spark.createDataFrame([(*r, "x", 5) for r in base], "doc_id long, text string, source string, row string, t_h int")
    plan = Counter()
    for r in M.mix(df).collect():
        plan[r.doc_id] += r.epochs
    out = M.mixed_rows(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +plan
    assert M.mixed_rows(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0


def test_light_source_fills_its_bins_evenly(spark):
    """Documents of symbols have the least weight; their keys still spread over the bins."""
    data = [(k, "### " * (k % 7 + 1) if k % 10 else "plain words here", "odd" if k % 3 else "plain") for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in M.mix(df).collect()), key=str)
    assert got == slow_mix(data)
    base = df.select("doc_id", "source", M.quality_weight(df["text"]).alias("w"))
    keys = [(r.source, r.w, -math.log((int(hashlib.md5(f"{M.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / r.w) for r in base.collect()]
    odd = [(w, k) for s, w, k in keys if s == "odd"]
    share = [sum(1 - math.exp(-k * w) for w, _ in odd) / len(odd) for _, k in odd]
    assert max(Counter(int(x * 44) for x in share).values()) < 3 * len(odd) / 44


def test_very_long_text_and_clashing_names(spark):
    data = [(1, "w " * 300_000, "a", 1, 2, 3), (2, "x y", "a", 1, 2, 3), (2, "x y", "a", 1, 2, 3), (None, "x y", None, 1, 2, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, key int, bins int, n int")
    assert sorted((r.doc_id or 0, r.size) for r in M.mix(df, carry=("key", "n")).collect()) == [(0, 2), (1, 300_000), (2, 2), (2, 2)]
    assert M.mixed_rows(df).columns == df.columns
