"""Byte-level BPE encoding and decoding.

Encoding gives the ids that the ``tokenizers`` library gives for the same JSON file with
``add_special_tokens=False``: added tokens are cut out first, the rest is split by the byte-level pattern, and each
piece is merged.

Method: a pair occurrence index.  All new pieces of an Arrow batch form one symbol list; every
adjacent pair is mapped to all its positions there.  A heap holds the ranks that occur; the least one
is applied at all its positions at once, and only the lists of the neighbouring pairs change.  As merges
in one piece don't touch another, this equals merging piece by piece.

What has been encoded stays in a bounded table per worker process, keyed by *segments*: white space followed by
non-space.  A piece never runs over the border from non-space to white space, so a segment's ids don't
depend on what surrounds it.  The table is emptied when it is full; that changes the time, not the ids.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any
length are read whole; no ties arise (a rank belongs to one pair, and its places are taken from left to right); rows that repeat an id or a text have rows of their own with
equal results; a null id is kept as null; an empty table gives an empty table; other columns, whatever their names, are not read; an id outside the vocabulary raises ``ValueError``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex

#: Fixed value: the published byte-level splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Segments that a worker process remembers at most.
CACHE = 1_000_000

#: All characters that Python or the pattern take for white space.
SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\s", c))

_BEND = tuple(c + " " for c in SPACES)


def byte_alphabet() -> dict[int, str]:
    """Byte to character: printable Latin-1 stands for itself, the others get 256, 257, ... in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def segments(text: str) -> list[str]:
    """Cuts a text at every border from non-space to a space; joined again they are the text."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    if not any(x in text for x in _BEND):  # no white space before any space: each part stands alone
        head, *tail = parts
        out = [" " + p for p in tail]
        return [head, *out] if head else out
    out, open_ = [], parts[0]
    for p in parts[1:]:
        if open_ and open_[-1] not in SPACES:
            out.append(open_)
            open_ = " " + p
        else:
            open_ += " " + p
    out.append(open_)
    return out


def plain_byte_level(spec: dict) -> str:
    """Why a tokenizer file can't be encoded segment by segment; "" if it can."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or not pre.get("use_regex", True):
        return "not a plain byte-level BPE file"
    for t in spec.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or any(c in SPACES for c in t["content"]):
            return "added tokens with white space, single_word, lstrip or rstrip are not supported"
    return ""


class Bpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if why := plain_byte_level(spec):
            raise ValueError(f"{why}: {path}")
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if (vocab[a], vocab[b]) not in self.merges:
                self.merges[vocab[a], vocab[b]] = (len(self.merges), vocab[a + b])
        self.ranked = list(self.merges)
        keys = np.array([(a << 20) | b for a, b in self.ranked] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([m[0] for m in self.merges.values()] or [0], np.int64)[order]
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.added: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    # -- the pair occurrence index -------------------------------------------------------------
    def _index(self, sym: np.ndarray) -> dict[int, list[int]]:
        """Maps the rank of every pair that can be merged to its positions."""
        pair = (sym[:-1] << 20) | sym[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        spots = np.flatnonzero((self.keys[at] == pair) & (sym[:-1] >= 0) & (sym[1:] >= 0))
        rank = self.key_rank[at[spots]]
        order = np.argsort(rank, kind="stable")
        rank, spots = rank[order], spots[order]
        if not len(rank):
            return {}
        start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        flat, ends = spots.tolist(), [*start[1:].tolist(), len(rank)]
        return {r: flat[i:j] for r, i, j in zip(rank[start].tolist(), start.tolist(), ends)}

    def merge_all(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        of_byte, merges = self.of_byte, self.merges
        sym: list[int] = []
        for p in pieces:
            sym.extend([of_byte[b] for b in p.encode()])
            sym.append(-1)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        where = self._index(np.array(sym, np.int64))
        get = merges.get
        active = list(where)
        heapq.heapify(active)
        ranked = self.ranked
        while active:
            rank = heapq.heappop(active)
            spots = where.pop(rank, None)
            if spots is None:
                continue
            a, b = ranked[rank]
            new = merges[a, b][1]
            spots.sort()
            for i in spots:
                if sym[i] != a:
                    continue
                j = right[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                    m = get((new, sym[k]))
                    if m is not None:
                        if m[0] in where:
                            where[m[0]].append(i)
                        else:
                            where[m[0]] = [i]
                            heapq.heappush(active, m[0])
                h = left[i]
                if h >= 0:
                    m = get((sym[h], new))
                    if m is not None:
                        if m[0] in where:
                            where[m[0]].append(h)
                        else:
                            where[m[0]] = [h]
                            heapq.heappush(active, m[0])
        out: list[tuple[int, ...]] = []
        piece: list[int] = []
        for s in sym:
            if s >= 0:
                piece.append(s)
            elif s == -1:
                out.append(tuple(piece))
                piece = []
        return out

    def _learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of segments that are not in the table yet."""
        cut: dict[str, list[str | int]] = {}
        for s in new:
            if self.cut is not None and "<" in s or self.cut is not None and self.cut.search(s):
                parts: list[str | int] = []
                for x in self.cut.split(s):
                    parts.extend([self.added[x]] if x in self.added else self.split.findall(x))
                cut[s] = parts
            else:
                cut[s] = self.split.findall(s)
        pieces = list({p for ps in cut.values() for p in ps if isinstance(p, str)})
        ids = dict(zip(pieces, self.merge_all(pieces)))
        return {s: tuple(i for p in ps for i in ((p,) if isinstance(p, int) else ids[p])) for s, ps in cut.items()}

    def batches(self, texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[list[str], dict[str, tuple[int, ...]]]]:
        """Per text its segments, with a table that holds them all."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < chars):
                cut.append(segments(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            fresh = list({s for c in cut for s in c if s not in self.known})
            if len(self.known) + len(fresh) > CACHE:
                self.known = {}
                fresh = list({s for c in cut for s in c})
            if fresh:
                self.known.update(self._learn(fresh))
            for c in cut:
                yield c, self.known

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for cut, known in self.batches(texts):
            yield list(chain.from_iterable(map(known.__getitem__, cut)))

    def decode_bytes(self, ids) -> bytes:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no such id: {e}") from None

    def decode(self, ids) -> str:
        """The text; bytes that are not UTF-8 become U+FFFD, as in the library's decoder."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_OPEN: dict[str, Bpe] = {}


def open_bpe(path: str) -> Bpe:
    """One encoder per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


def encode_decode(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    import hashlib

    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        bpe = open_bpe(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for ids in bpe.encode(b["text"].to_pylist()):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
