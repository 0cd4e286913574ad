"""Archives: exact round trip, one member a record, revisits, and lost attempts."""

import gzip
import hashlib
import io
import json
import zlib

import pytest

from weftline.llm import warc
from weftline.llm.warc import inflated, records


def expected(pages):
    first = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        if page is not None and len(payload) >= 100:
            first[payload] = min(first.get(payload, page), page)
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        lead = first.get(payload, page) if page is not None else None
        again = lead != page
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", lead if again else None, None if again else payload))
    return out


PAGES = [
    (1, "http://a/\r\nX: y", "<p>é" + "a" * 200),
    (2, "http://b", "<p>é" + "a" * 200),
    (5, None, "<p>é" + "a" * 200),
    (3, "http://c", "short"),
    (4, "http://d", "short"),
    (6, "http://e", None),
    (7, "http://f", ""),
    (8, "http://g", "WARC/1.1\r\n\r\n" * 40000),
    (9, "http://h", "b" * 99),
    (10, "http://h", "b" * 99),
    (11, "http://h", "c" * 100),
    (11, "http://h", "c" * 100),
    (12, "http://h", "c" * 100),
    (None, "http://h", "c" * 100),
]


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, digest string, size int")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    written = warc.write_archives(frame, a, archive_bytes=1000)
    normal = warc.normalise(written, a, b)
    places = warc.index(normal, b)
    rows = warc.read_records(places, b).collect()
    key = lambda r: (r[0] is None, r)
    found = [tuple(r[:5]) + (None if r.payload is None else bytes(r.payload),) for r in rows]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(PAGES)))
    # The written archives are one member each, the normalised ones a member a record.
    for name in (r.archive for r in written.collect()):
        stream = zlib.decompressobj(31)
        stream.decompress((tmp_path / "a" / name).read_bytes())
        assert stream.eof and not stream.unused_data
    for name in (r.archive for r in normal.collect()):
        data, at = (tmp_path / "b" / name).read_bytes(), 0
        for line in (tmp_path / "b" / f"{name}.index").read_text().splitlines():
            place = json.loads(line)
            assert place["offset"] == at
            at += place["length"]
            assert gzip.decompress(data[place["offset"] : at]).startswith(b"WARC/1.1\r\n")
        assert at == len(data)


def test_leftover_of_a_lost_attempt_is_not_read(spark, tmp_path):
    frame = spark.createDataFrame(PAGES[:2], "page_id bigint, url string, html string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    written = warc.write_archives(frame, a)
    (tmp_path / "a" / "lost.warc.gz").write_bytes(b"half")
    assert warc.read_records(warc.index(warc.normalise(written, a, b), b), b).count() == 2


def test_empty(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    written = warc.write_archives(frame, str(tmp_path / "a"))
    assert warc.index(warc.normalise(written, str(tmp_path / "a"), str(tmp_path / "b")), str(tmp_path / "b")).collect() == []


def test_members_in_any_blocks():
    raw = b"x" * 3_000_000
    stream = gzip.compress(raw[:10]) + gzip.compress(raw[10:])
    import pyarrow as pa

    assert b"".join(warc.inflated(pa.BufferReader(stream))) == raw


def stream(*parts):
    return b"".join(head.encode("latin-1") + b"\r\n\r\n" + body + b"\r\n\r\n" for head, body in parts)


def test_records_of_other_writers():
    heads = [
        "WARC/1.0\r\ncontent-length:3\r\nwarc-type:response",
        "WARC/1.1\r\nCONTENT-LENGTH: 0\r\nWARC-Type:   metadata  ",
        "WARC/1.1\r\nWARC-Target-URI: http://x/caf\xe9?a=b:c\r\nContent-Length: 5\r\nX-Note: one\r\n\ttwo",
    ]
    raw = stream(*zip(heads, (b"abc", b"", b"\r\n\r\n\xff")))
    for size in (1, 7, len(raw)):
        found = list(records(raw[i : i + size] for i in range(0, len(raw), size)))
        assert [h["Content-Length"] for h, _ in found] == ["3", "0", "5"] and b"".join(x for _, x in found) == raw
        assert [h.get("WARC-Type") for h, _ in found] == ["response", "metadata", None]
        assert found[2][0]["warc-target-uri"].encode("utf-8", "surrogateescape") == b"http://x/caf\xe9?a=b:c"
        assert found[2][0]["x-note"] == "one two"


@pytest.mark.parametrize("raw", [b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nno header\r\n\r\n", stream(("WARC/1.1\r\nContent-Length: 9", b"abc"))])
def test_other_streams_are_errors(raw):
    with pytest.raises(ValueError):
        list(records(iter([raw])))


def test_gzip_streams_that_end_early():
    raw = stream(*[("WARC/1.1\r\nContent-Length: 3", b"abc")] * 50)
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = zipped.compress(raw) + zipped.flush()
    assert b"".join(inflated(io.BytesIO(whole + whole + b"\0" * 20))) == 2 * raw
    for cut in (len(whole) - 1, len(whole) - 8, len(whole) // 2, len(whole) + 5):
        with pytest.raises(ValueError, match="ends within a member"):
            list(inflated(io.BytesIO((whole + whole)[:cut])))
