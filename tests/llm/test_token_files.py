import zlib

import numpy as np
import pytest

from lexmill.llm import token_files as T
from lexmill.llm.queries import tokenizer_path


@pytest.mark.parametrize("kind", [T.BYTE_PLANES, T.BIT_PLANES])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (T.from_planes(T.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", [T.BYTE_PLANES, T.BIT_PLANES])
def test_shard_round_trip(tmp_path, kind):
    r = np.random.default_rng(1)
    docs = [(i if i % 5 else None, r.integers(0, 50_000, int(n)).astype("<u4")) for i, n in enumerate(r.integers(0, 900, 50))]
    w = T.ShardWriter(f"{tmp_path}/x/a.tok", kind, block_ids=256)
    for i, ids in docs:
        w.add(i, ids.tobytes())
    info = w.close()
    assert info["n_docs"] == 50 and info["n_ids"] == sum(len(d) for _, d in docs)
    reader = T.ShardReader(info["path"])
    for (i, a), (j, b) in zip(docs, reader.documents(), strict=True):
        assert i == j and (a == b).all()
    everything = np.concatenate([d for _, d in docs])
    assert (reader.block(3) == everything[3 * 256 : 4 * 256]).all()


def test_query_matches_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "one two  three\n four", "<|endoftext|> x", "a" * 70_000 + " b", "same", "same", " \n ", "ünï cödé 中"]
    df = spark.createDataFrame([(len(texts) - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, path int").repartition(3)
    got = sorted(T.read_tokens(T.write_tokens(df, tokenizer_path())).collect())
    start = 0
    for row, (i, t) in zip(got, sorted((len(texts) - i, t) for i, t in enumerate(texts)), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert T.read_tokens(T.write_tokens(df.limit(0), tokenizer_path())).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x"), (3, "y"), (3, "y"), (None, None)], "doc_id long, text string")
    got = T.read_tokens(T.write_tokens(df, tokenizer_path())).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 1), (-1, 2), (3, 2), (3, 2)]


def test_block_encoder_matches_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n", "a\n b", "a\t\tb c", "\n\n", "x\n\ny z\n", "don't  'tis", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "ünï cödé 中文 ", "é  x y", "  b", "\x1c x", "Ġ ĠĠ x", "0 12 345.6 ", "word " * 3000]
    r = np.random.default_rng(5)
    texts += ["".join(r.choice(list("ab '.\n\t1é")) for _ in range(int(n))) for n in r.integers(1, 60, 400)]
    texts += [" ".join("".join(r.choice(list("abc'é.,1"), int(k))) for k in r.integers(1, 6, 200)) for _ in range(20)]
    encoder = T.LibraryEncoder(tokenizer_path())
    for size in (1, 50, 1_000_000):
        got = list(encoder.encode(pa.array(texts), size))
        assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.plain = False
    assert [g.tolist() for g in encoder.encode(pa.array(texts[:30]))] == [lib.encode(t, add_special_tokens=False).ids for t in texts[:30]]
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def test_very_long_text(spark):
    rows = [(1, "word, another " * 60_000, 5), (2, "x", 6), (2, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in T.read_tokens(T.write_tokens(df, tokenizer_path())).collect())
    assert got == [(1, 0, 180_002), (2, 180_002, 2), (2, 180_004, 2)]
