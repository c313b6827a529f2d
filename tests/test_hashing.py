import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import hashing as H

K0, K1 = 0x0706050403020100, 0x0F0E0D0C0B0A0908


def slow_siphash(data, k0, k1):
    mask = (1 << 64) - 1
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & mask
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def turn():
        v[0] = (v[0] + v[1]) & mask
        v[1] = rot(v[1], 13) ^ v[0]
        v[0] = rot(v[0], 32)
        v[2] = (v[2] + v[3]) & mask
        v[3] = rot(v[3], 16) ^ v[2]
        v[0] = (v[0] + v[3]) & mask
        v[3] = rot(v[3], 21) ^ v[0]
        v[2] = (v[2] + v[1]) & mask
        v[1] = rot(v[1], 17) ^ v[2]
        v[2] = rot(v[2], 32)

    padded = data + bytes(-(len(data) + 1) % 8) + bytes([len(data) & 255])
    for k in range(0, len(padded), 8):
        m = int.from_bytes(padded[k : k + 8], "little")
        v[3] ^= m
        turn()
        turn()
        v[0] ^= m
    v[2] ^= 255
    for _ in range(4):
        turn()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def hashed(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    return H.siphash(data, np.r_[0, np.cumsum(size)[:-1]], size, K0, K1).tolist()


def test_published_vectors():
    assert hashed([b""]) == [0x726FDB47DD0E0E31]
    assert hashed([bytes(range(15))]) == [0xA129CA6149BE45E5]


def test_all_lengths():
    parts = [bytes(range(n)) for n in range(70)]
    assert hashed(parts) == [slow_siphash(p, K0, K1) for p in parts]


def slow_vector(text, c):
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    code = lambda us: b"".join(chr(u).encode("utf-8", "surrogatepass") for u in us)
    grams = [code(units[i : i + n]) for n in range(c.char_min, c.char_max + 1) for i in range(len(units) - n + 1)]
    words = [w for w in text.split(" ") if w]
    word_code = lambda w: code(np.frombuffer(w.encode("utf-16-le", "surrogatepass"), "<u2").tolist())
    grams += [word_code(" ".join(words[i : i + n])) for n in range(c.word_min, c.word_max + 1) for i in range(len(words) - n + 1)]
    out = {}
    for g in grams:
        h = slow_siphash(g, c.key0, c.key1)
        b = (h - (1 << 64) if h >> 63 else h) % c.num_features
        out[b] = out.get(b, 0) + 1
    return dict(sorted(out.items()))


@pytest.mark.parametrize("config", [H.HashingConfig(K0, K1), H.HashingConfig(3, 4, 64, 1, 2, 1, 3)])
def test_vectors(config):
    texts = ["", "a", "café €100", "abc abc abc", "emoji \U0001f600 x", "word " * 200, "x" * 400]
    for t, (i, v) in zip(texts, H.vectorize_texts([t.strip() for t in texts], config)):
        assert dict(zip(i.tolist(), v.tolist())) == slow_vector(t.strip(), config)


def test_column(spark):
    df = spark.createDataFrame([("Hello World",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(H.vectorize(F.col("t"), H.HashingConfig(1, 2))).collect()]
    assert got[0]["indices"] == sorted(set(got[0]["indices"])) and sum(got[0]["values"]) == 9 + 8 + 7 + 3
    assert got[1]["indices"] == [] or got[1]["indices"] is None
    assert got[2]["indices"] == []


def test_config():
    with pytest.raises(ValueError):
        H.HashingConfig(1, 2, num_features=0)
    with pytest.raises(ValueError):
        H.HashingConfig(1, 2, char_min=5, char_max=3)
    assert H.HashingConfig.random_key().num_features == 1 << 18


def test_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("a b c",), ("",)], "t string")
    got = df.select(H.char_ngrams(F.col("t"), 3, 5).alias("c"), H.word_ngrams(F.col("t")).alias("w")).collect()
    assert got[0].c == ["abc", "bcd", "abcd"] and got[1].w == ["a", "b", "c", "a b", "b c"] and got[2].c == [] and got[2].w == []
