"""N-grams and keyed feature hashing.

``vectorize`` is SipHash-2-4 over character and word n-grams, vectorised with NumPy over Arrow batches: one pass, no
shuffle.  ``portable_features`` uses MD5 instead, which other SQL engines have, too.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import normalize

VECTOR = "struct<indices:array<int>,values:array<float>>"
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class HashingConfig:
    """Key and ranges of the feature hashing."""

    key0: int
    key1: int
    num_features: int = 1 << 18
    char_min: int = 3
    char_max: int = 5
    word_min: int = 1
    word_max: int = 2

    def __post_init__(self):
        if self.num_features < 1:
            raise ValueError("num_features must be positive")
        if not 1 <= self.char_min <= self.char_max or not 1 <= self.word_min <= self.word_max:
            raise ValueError("n-gram ranges must be positive and ascending")

    @classmethod
    def random_key(cls, **more) -> HashingConfig:
        return cls(secrets.randbits(63), secrets.randbits(63), **more)


def _rotate(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    np.left_shift(x, np.uint64(n), out=spare)
    np.right_shift(x, np.uint64(64 - n), out=x)
    np.bitwise_or(x, spare, out=x)


def _rounds(v: list[np.ndarray], n: int, spare: np.ndarray) -> None:
    """SipRounds in place."""
    a, b, c, d = v
    for _ in range(n):
        a += b
        _rotate(b, 13, spare)
        b ^= a
        _rotate(a, 32, spare)
        c += d
        _rotate(d, 16, spare)
        d ^= c
        a += d
        _rotate(d, 21, spare)
        d ^= a
        c += b
        _rotate(b, 17, spare)
        b ^= c
        _rotate(c, 32, spare)


#: Slices that are hashed together, so that the state stays in the processor's cache.
_TOGETHER = 1 << 14


def siphash(data: np.ndarray, start: np.ndarray, length: np.ndarray, key0: int, key1: int) -> np.ndarray:
    """SipHash-2-4 of the slices ``data[start : start + length]`` (uint8), as uint64."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = np.empty(len(start), np.uint64)
    k0, k1 = np.uint64(key0 & _MASK), np.uint64(key1 & _MASK)
    full = length >> 3
    for blocks in np.unique(full).tolist():
        every = np.flatnonzero(full == blocks)
        for first in range(0, len(every), _TOGETHER):
            pick = every[first : first + _TOGETHER]
            at, size = start[pick], length[pick]
            n = len(pick)
            v = [np.full(n, k ^ np.uint64(c)) for k, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573))]
            spare = np.empty(n, np.uint64)
            for b in range(blocks):
                m = words[at + 8 * b]
                v[3] ^= m
                _rounds(v, 2, spare)
                v[0] ^= m
            rest = (size & 7).astype(np.uint64)
            last = (words[at + 8 * blocks] & ((np.uint64(1) << (np.uint64(8) * rest)) - np.uint64(1))) | (size.astype(np.uint64) << np.uint64(56))
            v[3] ^= last
            _rounds(v, 2, spare)
            v[0] ^= last
            v[2] ^= np.uint64(0xFF)
            _rounds(v, 4, spare)
            out[pick] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def _grams(text: str, c: HashingConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a normalised text, and start and length of each of its n-grams.  Units are those of UTF-16, each
    encoded on its own (so a character beyond the basic plane is two units of three bytes)."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    if len(text) == len(units):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    else:
        data = np.frombuffer(b"".join(chr(u).encode("utf-8", "surrogatepass") for u in units.tolist()), np.uint8)
    width = 1 + (units >= 0x80).astype(np.int64) + (units >= 0x800)
    edge = np.concatenate([[0], np.cumsum(width)])
    first, last = [], []
    n = len(units)
    for size in range(c.char_min, min(c.char_max, n) + 1):
        first.append(edge[: n - size + 1])
        last.append(edge[size:])
    gap = np.flatnonzero(units == 0x20)
    lo, hi = np.concatenate([[0], gap + 1]), np.concatenate([gap, [n]])
    words = hi > lo
    lo, hi = lo[words], hi[words]
    for size in range(c.word_min, min(c.word_max, len(lo)) + 1):
        first.append(edge[lo[: len(lo) - size + 1]])
        last.append(edge[hi[size - 1 :]])
    if not first:
        return data, np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = np.concatenate(first), np.concatenate(last)
    return data, start, end - start


def vectorize_texts(texts: list[str], c: HashingConfig, grams: int = 2_000_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted buckets and counts of normalised texts; hashes at most about ``grams`` n-grams at a time."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        parts, size, shift = [], 0, 0
        while at < len(texts) and (not parts or size < grams):
            data, start, length = _grams(texts[at], c)
            parts.append((data, start + shift, length))
            shift += len(data)
            size += len(start)
            at += 1
        start, length = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        h = siphash(np.concatenate([p[0] for p in parts]), start, length, c.key0, c.key1)
        bucket = h.view(np.int64) % c.num_features
        owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        key, count = np.unique(owner * c.num_features + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(parts) + 1) * c.num_features)
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            out.append(((key[i:j] - k * c.num_features).astype(np.int32), count[i:j].astype(np.float32)))
    return out


def vectorize(c: Column, config: HashingConfig, normalizer=normalize) -> Column:
    """Text to a sparse vector ``struct<indices,values>``."""

    @F.arrow_udf(VECTOR)
    def hashed(texts):
        import pyarrow as pa

        rows = vectorize_texts([t or "" for t in texts.to_pylist()], config)
        edge = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int32)
        flat = lambda k, t: pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([r[k] for r in rows]) if rows else [], t))
        return pa.StructArray.from_arrays([flat(0, pa.int32()), flat(1, pa.float32())], ["indices", "values"])

    return hashed(normalizer(c))


def _windows(items: Column, n: int, glue: str) -> Column:
    """Every run of ``n`` items, joined."""
    every = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, n), glue))
    return F.when(F.size(items) >= n, every).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of a text, linear in its length."""

    def of(chars: Column) -> Column:
        return F.concat(*[_windows(chars, n, "") for n in range(low, high + 1)])

    return F.get(F.transform(F.array(F.array_remove(F.split(c, ""), "")), of), F.lit(0))


def word_ngrams(c: Column, low: int = 1, high: int = 2) -> Column:
    def of(words: Column) -> Column:
        return F.concat(*[_windows(words, n, " ") for n in range(low, high + 1)])

    return F.get(F.transform(F.array(F.array_remove(F.split(c, " "), "")), of), F.lit(0))


def portable_bucket(c: Column, num_features: int) -> Column:
    """A bucket from an MD5."""
    return (F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % num_features).cast("int")


def portable_vector(words: Column, num_features: int) -> Column:
    """A list of words to a sparse vector ``struct<indices,values>`` of ``portable_bucket``s, in one pass: every distinct word of a batch is
    hashed once, and nothing is exploded or shuffled.  A null list has an empty vector."""

    @F.arrow_udf(VECTOR)
    def hashed(lists):
        from hashlib import md5

        import pyarrow as pa

        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = lists.flatten().dictionary_encode()
        bucket = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % num_features for w in code.dictionary.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        key, count = np.unique(owner * num_features + bucket[code.indices.to_numpy(zero_copy_only=False)] if len(owner) else owner, return_counts=True)
        edge = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * num_features).astype(np.int32))
        flat = pa.ListArray.from_arrays(edge, pa.array((key % num_features).astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(count.astype(np.float32)))
        return pa.StructArray.from_arrays(flat, ["indices", "values"])

    return hashed(words)
