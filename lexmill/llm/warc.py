"""WARC derivatives: responses become linked metadata and plain-text conversion records.

For each ``response`` record two records come out.  Both name their source in ``WARC-Refers-To`` and keep
its target URI, date and warcinfo id.

* ``conversion``: the text that a reader of the page sees, ``text/plain``, with its own block digest.
* ``metadata``: ``application/warc-fields`` with the id of the conversion record, status, content type, character set, title,
  outlinks, the source's digests, and every WARC and HTTP header of the source as it was.

Record ids are name-based UUIDs of the source's id and the kind, so a task that runs again writes the same
records.  ``read_records`` streams files record by record (gzip members or plain), ``write_records`` writes
one gzip member a record; a manifest lists the files of finished tasks only.

Defined results: texts of any length are read whole, a record at a time in memory; rows that repeat a record give equal derivatives
(record ids included), and no other ties arise; a payload in a coding that can't be read here (``br``) has no text and says so in its metadata; a
damaged gzip member or record of a file gives a row with the reason, and reading goes on at the next; other record types have no derivatives; a record that can't be read gives one row of type ``error``
with the reason in ``block``; a response without a record id gets one from its content; null input rows give
nothing; broken character codes become U+FFFD; an empty table gives an empty table; other columns are kept by ``carry``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import new_path, stage
from lexmill.llm.html_extract import Node, blocks, find_body, parse

VERSION, DATE, NAMESPACE = "WARC/1.0", "2024-01-01T00:00:00Z", uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


@dataclass(frozen=True)
class Record:
    headers: tuple[tuple[str, str], ...]
    block: bytes
    version: str = VERSION

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def encode(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"{self.version}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> tuple[tuple[str, str], ...]:
    out: list[list[str]] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if line[:1] in (" ", "\t") and out:
            out[-1][1] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append([k.strip(), v.strip()])
    return tuple((k, v) for k, v in out)


def records(stream, line: bytes = b"\n") -> Iterator[Record]:
    """Reads records one by one from a binary stream, whose last read line is ``line``; ``ValueError`` for what isn't one."""
    while True:
        line = line if line.startswith(b"WARC/") else stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:40]!r}")
        version, lines = line.decode("ascii", "replace").strip(), []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the record ends in its header")
            lines.append(line)
        headers = _headers(lines)
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not length.isdigit():
            raise ValueError(f"no Content-Length: {length!r}")
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ValueError("the record ends in its block")
        yield Record(headers, block, version)
        line = b"\n"


def all_records(stream) -> Iterator[tuple[Record | None, str | None]]:
    """(record, None) for each record, and (None, reason) where there is none; goes on at the next version line."""
    line = b"\n"
    while True:
        try:
            for r in records(stream, line):
                yield r, None
            return
        except ValueError as e:
            yield None, str(e)
        while (line := stream.readline()) and not line.startswith(b"WARC/"):
            pass
        if not line:
            return


def members(raw, chunk: int = 1 << 20) -> Iterator[tuple[bytes, str | None]]:
    """The contents of each gzip member of a binary stream; of a damaged one what comes before the damage, and the reason.  Goes on at
    the next mark of a member."""
    buf = raw.read(chunk)
    while buf:
        member, out, seen, why = zlib.decompressobj(31), [], buf, None
        try:
            while True:
                out.append(member.decompress(buf))
                if member.eof:
                    break
                buf = raw.read(chunk)
                seen += buf
                if not buf:
                    raise EOFError("the file ends in a gzip member")
        except (zlib.error, EOFError) as e:
            why = str(e)
        yield b"".join(out), why
        if why is None:
            buf = member.unused_data or raw.read(chunk)
            continue
        at = seen.find(b"\x1f\x8b\x08", 1)
        while at < 0 and (more := raw.read(chunk)):
            seen = seen[-2:] + more
            at = seen.find(b"\x1f\x8b\x08")
        buf = seen[at:] if at >= 0 else b""


def response(url: str | None, body: bytes, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> Record:
    """A response record for a page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    target = () if url is None else (("WARC-Target-URI", re.sub(r"\s+", "%20", url)),)
    head = (("WARC-Type", "response"), ("WARC-Record-ID", named_id("response", url or "", digest(block))), *target, ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))))
    return Record(head, block)


# -- from a response to its derivatives ---------------------------------------------------------
def _inflate(body: bytes, wbits: int) -> tuple[bytes, bool]:
    """All members of a compressed payload, and whether it ends before its end or in something else."""
    out, cut = [], False
    while body:
        member = zlib.decompressobj(wbits)
        try:
            out.append(member.decompress(body))
        except zlib.error:
            if not out:
                raise
            return b"".join(out), True
        cut, body = not member.eof, member.unused_data.lstrip(b"\0")
    return b"".join(out), cut


def _payload(block: bytes) -> tuple[str, tuple[tuple[str, str], ...], bytes, str]:
    """Status line, HTTP headers, the decoded payload and what is wrong with it: "truncated", "undecoded" or nothing."""
    stream = io.BytesIO(block)
    status = stream.readline().decode("latin-1").strip()
    if not status.startswith("HTTP/"):
        return "", (), block, ""
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line)
    headers, body = _headers(lines), stream.read()
    of = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        body = _unchunk(body)
    coding, cut = of.get("content-encoding", ""), False
    try:
        if "gzip" in coding:
            body, cut = _inflate(body, 47)
        elif "deflate" in coding:
            body, cut = _inflate(body, -15 if body[:1] and body[0] & 15 != 8 else 15)
        elif "zstd" in coding and body.startswith(b"\x28\xb5\x2f\xfd"):
            import zstandard

            try:
                body = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(body)
            except zstandard.ZstdError:
                return status, headers, b"", "undecoded"
        elif coding.strip() in ("br", "compress", "x-compress"):
            return status, headers, b"", "undecoded"
    except zlib.error:
        pass  # sent without the coding that its header names
    return status, headers, body, "truncated" if cut else ""


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _charset(content_type: str, body: bytes) -> str:
    import codecs

    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I) or re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", body[:4096], re.I)
    name = (m[1].decode("ascii", "replace") if isinstance(m[1], bytes) else m[1]) if m else "utf-8"
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "utf-8"


def _facts(root: Node) -> tuple[str, list[str]]:
    """Title and outlinks of a page."""
    title, found, todo = "", [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "title" and not title:
            title = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
        if node.tag == "a" and (href := node.attrs.get("href", "").strip()):
            found.append(" ".join(href.split()))
        todo += [k for k in node.kids if not isinstance(k, str)][::-1]
    return title, found


def derive(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response; nothing for other records."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    rid = source.get("WARC-Record-ID") or named_id("response", source.get("WARC-Target-URI") or "", digest(source.block))
    status, http, body, wrong = _payload(source.block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = _charset(kind, body)
    page = body.decode(charset, "replace")
    if not kind or "html" in kind.lower() or "xml" in kind.lower():
        root = parse(page)
        text = "\n\n".join(t for _, t, _ in blocks(find_body(root), everything=True))
        title, outlinks = _facts(root)
    else:
        text, title, outlinks = page if kind.lower().startswith("text/") else "", "", []
    kept = tuple((k, v) for k in _KEPT if (v := source.get(k)) is not None)
    conversion_id, data = named_id(rid, "conversion"), text.encode()
    link = ("WARC-Refers-To", rid)
    conversion = Record((("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), link, *kept, ("WARC-Block-Digest", digest(data)), ("Content-Type", "text/plain; charset=utf-8"), ("Content-Length", str(len(data)))), data)
    fields = [("conversion-record-id", conversion_id), ("http-status", status), ("content-type", kind), ("charset", charset), ("title", title), ("text-characters", str(len(text))), ("source-payload-digest", source.get("WARC-Payload-Digest") or digest(body)), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block))]
    fields += [(f"payload-{wrong}", "content-encoding")] * bool(wrong) + [("outlink", x) for x in outlinks] + [("source-warc-header", f"{k}: {v}") for k, v in source.headers] + [("source-http-header", f"{k}: {v}") for k, v in http]
    data = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    metadata = Record((("WARC-Type", "metadata"), ("WARC-Record-ID", named_id(rid, "metadata")), link, *kept, ("WARC-Concurrent-To", conversion_id), ("WARC-Block-Digest", digest(data)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(data)))), data)
    return [metadata, conversion]


# -- in Spark ----------------------------------------------------------------------------------
_COLUMNS = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "block")
_TYPES = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, block string"


def _row(r: Record, payload_digest: str | None) -> tuple:
    return (r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("WARC-Date"), r.get("Content-Type"), len(r.block), r.get("WARC-Block-Digest"), payload_digest, r.block.decode("utf-8", "replace"))


def pages_to_responses(df: DataFrame, url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """Response records (column ``record``, binary) of a table of pages."""
    rows = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(carry)], df[url_col].cast("string").alias("url"), F.coalesce(df[html_col], F.lit("")).alias("html"))
    kept = rows.columns[: len(carry)]

    def run(batches):
        for b in batches:
            made = [response(u, h.encode()).encode() for u, h in zip(b["url"].to_pylist(), b["html"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(made, pa.binary())], [*kept, "record"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)]] + ["record binary"])
    return rows.mapInArrow(run, schema).toDF(*carry, "record")


def derivatives(df: DataFrame, record_col: str = "record", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per derived record, with ``carry`` columns of its source's row in front."""
    rows = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(carry)], df[record_col].alias("record"))
    kept = rows.columns[: len(carry)]

    def run(batches):
        for b in batches:
            at, out = [], []
            for k, data in enumerate(b["record"].to_pylist()):
                try:
                    for source in records(io.BytesIO(data or b"")):
                        made = derive(source)
                        out += [_row(r, source.get("WARC-Payload-Digest")) for r in made]
                        at += [k] * len(made)
                except ValueError as e:
                    out.append(("error", *[None] * 8, str(e)))
                    at.append(k)
            if out:
                where = pa.array(at, pa.int32())
                columns = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(_COLUMNS, zip(*out))]
                yield pa.RecordBatch.from_arrays([*[b[c].take(where) for c in kept], *columns], [*kept, *_COLUMNS])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)]] + [_TYPES])
    return rows.mapInArrow(run, schema).toDF(*carry, *_COLUMNS)


def derived_records(df: DataFrame, record_col: str = "record") -> DataFrame:
    """The derived records as bytes (column ``record``), to be written."""

    def run(batches):
        for b in batches:
            made = []
            for data in b["record"].to_pylist():
                try:
                    for source in records(io.BytesIO(data or b"")):
                        made += [r.encode() for r in derive(source)]
                except ValueError:
                    continue  # listed by derivatives()
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return df.select(df[record_col].alias("record")).mapInArrow(run, "record binary")


def write_records(df: DataFrame, at: str | None = None, record_col: str = "record", file_bytes: int = 1 << 30) -> DataFrame:
    """Writes one gzip member a record under ``at``; returns the manifest (path, n_records, n_bytes), a staged table."""
    at = at or new_path(df.sparkSession, "warc")

    def run(batches):
        from pyarrow import fs

        done, out, path, n, size = [], None, "", 0, 0
        for b in batches:
            for data in b["record"].to_pylist():
                if out is None:
                    uri = f"{at}/{uuid.uuid4().hex}.warc.gz"
                    store, path = fs.FileSystem.from_uri(uri)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, n, size, path = store.open_output_stream(path, compression=None), 0, 0, uri
                member = gzip.compress(data, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records", "n_bytes"])

    return stage(df.select(df[record_col].alias("record")).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_records(spark: SparkSession, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Streams the records of WARC files: path, number, record, error.  ``paths``: a table of their names.  What is damaged gives a row
    with the reason in ``error`` and no record, and the rest of the file is read."""
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("record", pa.binary()), ("error", pa.string())])

    def found(stream):
        if stream.peek(2)[:2] != b"\x1f\x8b":
            yield from all_records(stream)
            return
        for data, why in members(stream):
            for r, reason in all_records(io.BytesIO(data)):
                if reason is None or why is None:
                    yield r, reason
            if why is not None:
                yield None, why

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for uri in b["path"].to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for k, (r, why) in enumerate(found(io.BufferedReader(raw))):
                        rows.append((uri, k, None if r is None else r.encode(), why))
                        size += 0 if r is None else len(r.block)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.select(F.col(path_col).alias("path")).repartition(n, "path").mapInArrow(run, "path string, number long, record binary, error string")
