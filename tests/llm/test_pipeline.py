import hashlib
import re

import numpy as np

import corpus_pipeline as P
from lexmill.llm import quality as Q
from lexmill.llm.bpe import open_bpe
from lexmill.llm.queries import tokenizer_path

from tests.llm.test_mixing import slow_mix
from tests.llm.test_quality import corpus


def slow_quality(docs):
    shapes = Q._Shapes()
    found = [Q.describe(d[1] or "", shapes) for d in docs]
    pattern, count = np.unique([f[0] for f in found], return_counts=True)
    labels = Q.fit_label_model(pattern, count)
    sample = sorted(found)
    scorer = Q.fit_scorer([f[1:] for f in sample], 1 - labels.posterior_bad(np.array([f[0] for f in sample])))
    return [d for d, f in zip(docs, found) if scorer.score(f[1], f[2]) >= Q.THRESHOLD]


def slow_exact(docs):
    best = {}
    for d in docs:
        k = re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
        best[k] = min(best.get(k, d), d, key=lambda x: (-len(x[1] or ""), x[0]))
    return sorted(best.values())


def slow_near(docs):
    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(d[1]) for d in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [d for k, d in enumerate(docs) if find(k) == k]


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t, _ in corpus(160, 3)]
    docs += [(1000 + i, t + " ", "en", "src1", len(t) + 1) for i, t, *_ in docs[3:20]]
    docs += [(2000 + i, t + " more", "en", "src2", len(t) + 5) for i, t, *_ in docs[5:60]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, str(tmp_path)).collect())
    kept = slow_near(slow_exact(slow_quality(docs)))
    assert 50 < len(kept) < len(docs)
    text, bpe, want = {d[0]: d[1] for d in kept}, open_bpe(tokenizer_path()), []
    for i, size, _, _, taken in slow_mix([(d[0], d[1], d[3]) for d in kept]):
        ids = next(bpe.encode([text[i]]))
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest())
        want += [row] * (taken // size if size else 0)
    assert got == sorted(want)
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "Plain words make a text. " * 9, "en", None, 5), (2, "Plain words make a text. " * 9, "en", None, 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, step in P.STAGES[:-1]:
            docs = step(spark, docs, "")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, "").collect()} <= {2}

