"""Token-id files with shuffled bit or byte planes.

A shard is one binary file::

    b"LMTK" version:u16 plane_kind:u16 block_ids:u32
    blocks     each plane of each block, compressed with zstandard (an all-zero plane takes no bytes)
    documents  ids (i64), presence of an id (u8) and token counts (u32), each compressed
    index      per block: offset u64, ids u32, bytes of each plane u32 ...
    footer     offset of documents u64, of index u64, blocks u64, documents u64, ids u64, b"LMTK"

Ids are little-endian unsigned 32-bit numbers.  A block has ``block_ids`` of them (the last one fewer); its
bytes are transposed, so that all lowest bytes (or bits) come first, then the next ones.  The
index lets a reader fetch any block alone.

Documents come in ascending order of their ids (null first).  Spark deals them out by range, each task writes its
shards under names of its own, and only the rows that a finished task returns (the manifest, kept as Parquet) make
a shard part of the set: what a lost task left behind is never read.

Defined results: null and empty texts have the end id alone; texts of any length are encoded whole (a long one is a block by
itself, and its ids run over many blocks of the file); rows that repeat an id are documents of
their own, in the order of a hash of their texts (equal rows are equal in everything that is written); an empty table has no shard;
a null doc_id is kept as null; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bpe import SPACES, byte_alphabet, plain_byte_level
from lexmill.llm.common import new_path, stage, text_of

MAGIC, VERSION, HEAD, FOOT = b"LMTK", 1, struct.Struct("<4sHHI"), struct.Struct("<QQQQQ4s")
BYTE_PLANES, BIT_PLANES = 4, 32
BLOCK_IDS, SHARD_IDS, END_ID, LEVEL = 1 << 16, 1 << 24, 0, 3

#: Bytes of text that are encoded together, words in one string for the library.
BLOCK_BYTES, JOINED = 32_000_000, 1024
_BLANK_SPACE, _BLANK_END = "[" + "".join(SPACES) + "] ", "^$|[" + "".join(SPACES) + "]$"


# -- planes ------------------------------------------------------------------------------------
def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE_PLANES:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE_PLANES:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes]).T
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]).T
        raw = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


# -- files -------------------------------------------------------------------------------------
def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, kind: int = BYTE_PLANES, block_ids: int = BLOCK_IDS):
        import zstandard

        store, path = _open(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.kind, self.block_ids = uri, kind, block_ids
        self.out, self.at = store.open_output_stream(path), 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.index: list[bytes] = []
        self.open_: list[bytes] = []
        self.open_ids = self.n_ids = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self._put(HEAD.pack(MAGIC, VERSION, kind, block_ids))

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: a document's ids with the end id, as little-endian u32."""
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.open_.append(ids)
        self.open_ids += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.open_ids >= self.block_ids:
            held = np.frombuffer(b"".join(self.open_), "<u4")
            full = len(held) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(held[k : k + self.block_ids])
            self.open_, self.open_ids = [held[full:].tobytes()], len(held) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [b"" if not any(p) else self.pack(p) for p in to_planes(ids, self.kind)]
        at = self.at
        for p in planes:
            self._put(p)
        self.index.append(struct.pack(f"<QI{self.kind}I", at, len(ids), *map(len, planes)))

    def close(self) -> dict:
        if self.open_ids:
            self._block(np.frombuffer(b"".join(self.open_), "<u4"))
        at_docs = self.at
        for part in (np.array([i or 0 for i in self.ids], "<i8"), np.array([i is not None for i in self.ids], np.uint8), np.array(self.counts, "<u4")):
            data = self.pack(part.tobytes())
            self._put(struct.pack("<Q", len(data)))
            self._put(data)
        at_index = self._put(b"".join(self.index))
        self._put(FOOT.pack(at_docs, at_index, len(self.index), len(self.ids), self.n_ids, MAGIC))
        self.out.close()
        return {"path": self.uri, "n_docs": len(self.ids), "n_ids": self.n_ids, "n_bytes": self.at}


class ShardReader:
    def __init__(self, uri: str):
        import zstandard

        store, path = _open(uri)
        self.file = store.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        magic, version, self.kind, self.block_ids = HEAD.unpack(self._get(0, HEAD.size))
        at_docs, at_index, blocks, docs, self.n_ids, end = FOOT.unpack(self._get(size - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError(f"not a token file: {uri}")
        row = struct.Struct(f"<QI{self.kind}I")
        self.index = list(row.iter_unpack(self._get(at_index, blocks * row.size)))
        parts = []
        for kind in ("<i8", np.uint8, "<u4"):
            (n,) = struct.unpack("<Q", self._get(at_docs, 8))
            parts.append(np.frombuffer(self.unpack(self._get(at_docs + 8, n)), kind))
            at_docs += 8 + n
        self.doc_ids, self.has_id, self.counts = parts
        if len(self.counts) != docs:
            raise ValueError(f"damaged token file: {uri}")

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        data, planes = self._get(at, sum(sizes)), []
        empty = bytes(n if self.kind == BYTE_PLANES else (n + 7) // 8)
        for s in sizes:
            planes.append(self.unpack(data[:s]) if s else empty)
            data = data[s:]
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, holding a block and a document at a time."""
        held, k = np.empty(0, "<u4"), 0
        for i, has, n in zip(self.doc_ids.tolist(), self.has_id.tolist(), self.counts.tolist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield (i if has else None), held[:n]
            held = held[n:]


# -- encoding with the library -----------------------------------------------------------------
class LibraryEncoder:
    """Ids by the tokenizers library.

    For plain byte-level files a block of texts is cut before every space, and Arrow's dictionary encoding finds its distinct words.
    These go to the library, many in one string: as no token but a word's first one starts with a space, the ids fall apart at the tokens
    that do.  A text with white space before a space, and every text of another kind of file, is encoded as it is."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = not plain_byte_level(spec)
        if self.plain:
            blank, vocab = byte_alphabet()[0x20], spec["model"]["vocab"]
            added = [t["id"] for t in spec.get("added_tokens", [])]
            self.opens = np.zeros(max([*vocab.values(), *added]) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t.startswith(blank)]] = True
            self.opens[added] = False

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of " " + word for each word, all in a row, and the number of each word's."""
        cuts = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(0, len(words) + JOINED, JOINED), len(words)), pa.int32()), words)
        flat, sizes = [], []
        for ids, cut in zip(self._library([" " + x for x in pc.binary_join(cuts, " ").to_pylist()] if len(words) else []), pc.list_value_length(cuts).to_pylist()):
            start = np.flatnonzero(self.opens[ids])
            if len(start) != cut:
                raise AssertionError("a token inside a word starts with a space")
            flat.append(ids)
            sizes.append(np.diff(start, append=len(ids)))
        return flat, sizes

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and where each text's begin (one more at the end)."""
        parts = pc.split_pattern(texts, " ")
        edge, words = parts.offsets.to_numpy(), parts.values
        code = words.dictionary_encode()
        heads = words.take(pa.array(edge[:-1])).dictionary_encode()  # a text's first word has no space before it
        spot, n = code.indices.to_numpy().copy(), len(code.dictionary)
        spot[edge[:-1]] = n + heads.indices.to_numpy()
        odd = pc.match_substring_regex(code.dictionary, _BLANK_END)  # these can't stand before another word
        flat, sizes = self._after_space(code.dictionary.filter(pc.invert(odd)))
        alone = self._library([" " + x for x in code.dictionary.filter(odd).to_pylist()] + heads.dictionary.to_pylist())
        flat += alone
        sizes.append(np.array([len(x) for x in alone], np.int64))
        place = np.arange(n + len(heads.dictionary))  # a word's place among those sizes
        mark = odd.to_numpy(zero_copy_only=False)
        place[:n] = np.where(mark, (n - mark.sum()) + np.cumsum(mark) - 1, np.cumsum(~mark) - 1)
        table = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))]), pa.array(np.concatenate([*flat, np.empty(0, "<u4")])))
        taken = table.take(pa.array(place[spot]))
        return taken.values.to_numpy(), taken.offsets.to_numpy()[edge]

    def encode(self, texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
        """The ids of each text (none is null), in blocks of about ``size`` bytes."""
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while at < len(texts):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            part = texts.slice(at, last - at)
            whole = pc.match_substring_regex(part, _BLANK_SPACE) if self.plain else pa.array(np.ones(len(part), bool))
            here = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
            ids, edge = self._block(part.take(pa.array(here)) if len(here) < len(part) else part) if len(here) else (None, None)
            place = dict(zip(here.tolist(), range(len(here)))) if len(here) < len(part) else None
            for k in range(len(part)):
                j = k if place is None else place.get(k)
                yield self._library([part[k].as_py()])[0] if j is None else ids[edge[j] : edge[j + 1]]
            at = last


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One per worker process and file; its table outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_tokens(df: DataFrame, tokenizer: str, at: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, kind: int = BYTE_PLANES, partitions: int | None = None) -> DataFrame:
    """Writes the shards under ``at`` and returns the manifest, a staged table: part, path, n_docs, n_ids, n_bytes."""
    spark = df.sparkSession
    at = at or new_path(spark, "tokens")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df[text_col]).alias("text"))
    if partitions is None:
        partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("part", F.spark_partition_id())
    end = np.array([end_id], "<u4")
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        encoder = library_encoder(tokenizer)
        shard, part, number, done = None, 0, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            part = b["part"][0].as_py()
            for i, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["text"])):
                if shard is None:
                    shard = ShardWriter(f"{at}/{part:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.tok", kind)
                shard.add(i, np.concatenate([ids, end]).tobytes())
                if shard.n_ids >= SHARD_IDS:
                    done.append(shard.close() | {"part": part * 10_000 + number})
                    shard, number = None, number + 1
        if shard is not None:
            done.append(shard.close() | {"part": part * 10_000 + number})
        yield pa.RecordBatch.from_pylist(done, schema)

    return stage(rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the shards back: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist()):
                rows: list[tuple] = []
                for i, ids in ShardReader(path).documents():
                    rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
