import base64
import gzip
import hashlib
import io

import pytest

from lexmill.llm import warc as W

PAGE = "<html><head><title>A  title</title></head><body><nav><a href='/x'>menu</a></nav><p>One &amp; two</p><script>no</script></body></html>"


def test_round_trip():
    made = [W.response("http://a/b c", PAGE.encode()), W.response(None, b"")]
    data = b"".join(r.encode() for r in made)
    assert list(W.records(io.BytesIO(data))) == made


def test_derivatives_are_linked():
    source = W.response("http://a/b", PAGE.encode())
    metadata, conversion = W.derive(source)
    assert metadata.get("WARC-Refers-To") == conversion.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert conversion.block.decode() == "menu\n\nOne & two"
    assert conversion.get("WARC-Block-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(conversion.block).digest()).decode()
    fields = [x.split(": ", 1) for x in metadata.block.decode().split("\r\n") if x]
    assert ["title", "A title"] in fields and ["outlink", "/x"] in fields and ["conversion-record-id", conversion.get("WARC-Record-ID")] in fields
    assert ["source-payload-digest", source.get("WARC-Payload-Digest")] in fields
    for k, v in source.headers:
        assert ["source-warc-header", f"{k}: {v}"] in fields
    assert W.derive(source) == [metadata, conversion]
    assert W.derive(conversion) == []


@pytest.mark.parametrize("coding,body", [("gzip", gzip.compress(b"<p>h\xe9")), ("", b"<p>h\xe9")])
def test_payload_codings(coding, body):
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: " + coding.encode() + b"\r\n\r\n" + chunked
    source = W.Record((("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))), block)
    assert W.derive(source)[1].block.decode() == "hé"


def test_query_and_files(spark):
    rows = [(1, "http://a/1", PAGE, "x", 0), (2, None, None, "y", 0), (None, "http://a/2", "plain", None, 1), (1, "http://a/1", PAGE, "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string, k0 int").repartition(3)
    sources = W.pages_to_responses(df, carry=("page_id",))
    got = W.derivatives(sources, carry=("page_id",)).collect()
    assert len(got) == 8 and {r.warc_type for r in got} == {"metadata", "conversion"}
    assert sorted(r.block for r in got if r.warc_type == "conversion") == ["", "menu\n\nOne & two", "menu\n\nOne & two", "plain"]
    manifest = W.write_records(W.derived_records(sources))
    back = W.read_records(spark, manifest).collect()
    assert len(back) == 8 == sum(r.n_records for r in manifest.collect())
    read = [x for r in back for x in W.records(io.BytesIO(r.record))]
    assert sorted(x.get("WARC-Record-ID") for x in read) == sorted(r.record_id for r in got)
    assert W.derivatives(sources.limit(0), carry=("page_id",)).count() == 0


def test_broken_records(spark):
    good = W.response("http://a/1", b"x").encode()
    df = spark.createDataFrame([(1, good[:-20]), (2, b"nonsense"), (3, None), (4, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + good)], "i int, record binary")
    got = sorted((r.i, r.warc_type) for r in W.derivatives(df, carry=("i",)).collect())
    assert got == [(1, "error"), (2, "error"), (4, "conversion"), (4, "metadata")]


@pytest.mark.parametrize("body,text,cut", [(gzip.compress(b"<p>one") + gzip.compress(b" two"), "one two", False), (gzip.compress(b"<p>one") + gzip.compress(b" two")[:-8], "one two", True)])
def test_gzip_members(body, text, cut):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + body
    metadata, conversion = W.derive(W.Record((("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))), block))
    assert conversion.block.decode() == text and (b"payload-truncated" in metadata.block) == cut


def test_records_before_a_damaged_one_are_written(spark):
    good = W.response("http://a/1", b"x").encode()
    df = spark.createDataFrame([(bytearray(good + good[:-20]),)], "record binary")
    assert W.derived_records(df).count() == 2


def test_zstandard_and_unknown_codings():
    import zstandard

    for coding, body, text, wrong in (("zstd", zstandard.compress(b"<p>one two"), "one two", None), ("zstd", zstandard.compress(b"<p>one two")[:4] + b"\xff" * 40, "", b"payload-undecoded"), ("br", b"\x0b\x02\x80", "", b"payload-undecoded")):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: {coding}\r\n\r\n".encode() + body
        metadata, conversion = W.derive(W.Record((("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))), block))
        assert conversion.block.decode() == text and (wrong is None or wrong in metadata.block)


def test_damaged_files_are_read_on(spark, tmp_path):
    import random

    made = [W.response(f"http://a/{k}", bytes(random.Random(k).choices(b"abcdef <p>", k=4000))).encode() for k in range(6)]
    zipped = [gzip.compress(m) for m in made]
    broken = zipped[2][:600] + b"\0" * 40 + zipped[2][640:]
    (tmp_path / "a.warc.gz").write_bytes(zipped[0] + zipped[1] + broken + zipped[3] + zipped[4][:-900])
    (tmp_path / "b.warc").write_bytes(made[0] + b"junk\r\n" + made[1] + made[5][:-300])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(made[0] + made[1]) + gzip.compress(b"junk"))
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.warc.gz", "b.warc", "c.warc.gz", "d.warc.gz")], "path string")
    got = {}
    for r in sorted(W.read_records(spark, paths).collect(), key=lambda r: (r.path, r.number)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(made.index(bytes(r.record)) if r.record is not None else "error" if r.error else None)
    assert got == {"a.warc.gz": [0, 1, "error", 3, "error"], "b.warc": [0, "error", 1, "error"], "d.warc.gz": [0, 1, "error"]}


def test_very_long_page_and_clashing_names(spark):
    page = "<p>" + "word & word " * 100_000
    df = spark.createDataFrame([(1, "http://a", page, "x", "y")], "page_id long, url string, html string, block string, record_id string")
    sources = W.pages_to_responses(df, carry=("page_id", "block", "record_id"))
    got = W.derivatives(sources, carry=("page_id", "block", "record_id"))
    assert got.columns[:3] == ["page_id", "block", "record_id"] and got.columns.count("block") == 2
    rows = got.collect()
    assert len(rows) == 2 and {r[1] for r in rows} == {"x"} and any(len(r[-1]) == 1_199_999 for r in rows)
