import hashlib
import random

import pytest

from lexmill.llm import bpe as B
from lexmill.llm.queries import tokenizer_path

LETTERS = [*"ab  \n\t 　'stélñ<|>\U0001f600中\x85\x1c .!1", "<|endoftext|>", "'ll", "  ", "the", " and", "ing", "aaaa"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return B.Bpe(tokenizer_path())


def texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "a" * 5000, "\n" * 70, *("".join(r.choice(LETTERS) for _ in range(r.randrange(60))) for _ in range(n))]


def test_same_ids_as_the_library(library, own):
    t = texts(4000)
    got, want = list(own.encode(t)), library.encode_batch(t, add_special_tokens=False)
    assert [w.ids for w in want] == got
    assert [library.decode(w.ids, skip_special_tokens=False) for w in want] == [own.decode(g) for g in got]


def test_decode_of_cut_codes(library, own):
    r = random.Random(2)
    ids = list(own.encode(texts(300, 3)))
    for x in ids:
        part = x[r.randrange(len(x) + 1) :]
        assert own.decode(part) == library.decode(part, skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode([10**6])


def test_segments_join_to_the_text():
    for t in texts(2000, 4):
        assert "".join(B.segments(t)) == t


def test_full_table_changes_nothing(own, monkeypatch):
    t = texts(200, 5)
    want = list(own.encode(t))
    monkeypatch.setattr(B, "CACHE", 3)
    assert list(B.Bpe(tokenizer_path()).encode(t)) == want


def test_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(50, 6))] + [(None, None, None), (3, "a", "b"), (3, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_decode(df, tokenizer_path()).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert B.encode_decode(df.limit(0), tokenizer_path()).count() == 0
