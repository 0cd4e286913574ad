"""WARC archives of pages: written as one gzip stream each, then normalised to one gzip member a record.

A writing task streams its records into a single gzip member, as many tools do. The normaliser inflates each
such file once from end to end, rewrites every record as a member of its own, and
writes the place of every member to an index beside it, so that a record can be read by itself.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import filesystem, stored
from weftline.llm.textarrays import CHUNK_BYTES, chunks

#: Shorter payloads are always written in full.
LEAST_REVISIT = 100
#: Bytes of payload after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
_BLOCK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, kind: str, digest: str, refers_to: int | None, size: int, payload: bytes) -> bytes:
    """One WARC record; a revisit carries no payload."""
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """Header lines by name; names differ by more than case."""

    def __init__(self, lines: list[bytes]):
        super().__init__()
        name = ""
        for line in lines:
            # Bytes that are no UTF-8 are kept as they are.
            text = line.decode("utf-8", "surrogateescape")
            if text[:1] in (" ", "\t") and name:
                self[name] = f"{super().__getitem__(name)} {text.strip()}"
                continue
            name, colon, value = text.partition(":")
            name = name.strip().lower()
            if not colon:
                raise ValueError(f"no header line: {text!r}")
            super().__setitem__(name, value.strip())

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def get(self, name: str, other: str | None = None) -> str | None:
        return super().get(name.lower(), other)


def records(blocks: Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """Headers and raw bytes of each record of a WARC stream that comes in ``blocks``.

    Any case of header names, with or without a space after the colon, and folded lines are taken; bytes beyond UTF-8 are kept
    as surrogates. A stream that ends within a record, or a record without a length, is an error.
    """
    held, wanted = bytearray(), 0
    for block in blocks:
        held += block
        if len(held) < wanted:
            continue
        at = wanted = 0
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            version, *lines = bytes(held[at:head]).split(b"\r\n")
            headers = Headers(lines)
            if not version.startswith(b"WARC/") or not (headers.get("Content-Length") or "").isdigit():
                raise ValueError("no WARC record begins here")
            end = head + 4 + int(headers["Content-Length"]) + 4
            if len(held) < end:
                wanted = end - at
                break
            yield headers, bytes(held[at:end])
            at = end
        del held[:at]
    if held:
        raise ValueError("the WARC stream ends within a record")


def inflated(source) -> Iterator[bytes]:
    """Blocks of a gzip stream of one or more members; an error if the last one has no end."""
    unzip, within = zlib.decompressobj(31), False
    while block := source.read(_BLOCK):
        while block:
            within = True
            if out := unzip.decompress(block, _BLOCK):
                yield out
            if unzip.eof:
                # Zeros may fill up the file after a member.
                block, unzip, within = unzip.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
            else:
                block = unzip.unconsumed_tail
    if out := unzip.flush():
        yield out
    if within:
        raise ValueError("the gzip stream ends within a member")


def _write_rows(folder: str, archive_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        # A task that runs again writes names of its own; only files that a finished task names are read.
        name, out, zipped, size = "", None, None, 0
        done: list[str] = []
        for row in (row for batch in batches for part in chunks(batch, "html") for row in part.to_pylist()):
            if out is None:
                name = f"{uuid4().hex}.warc.gz"
                out, zipped, size = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
            payload = (row["html"] or "").encode()
            out.write(zipped.compress(record(row["page_id"], row["url"], row["kind"], row["digest"], row["refers_to"], len(payload), payload)))
            size += len(payload)
            if size >= archive_bytes:
                out.write(zipped.flush())
                out.close()
                done.append(name)
                out = None
        if out is not None:
            out.write(zipped.flush())
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    return rows


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives of one gzip stream each; their names: (archive).

    Of equal payloads of at least ``least_revisit`` bytes, that of the smallest page_id is a response
    and the others are revisits that refer to it. A null html is an empty payload. Rows that
    repeat the smallest page_id with its payload are all responses. Rows with a null page_id are all
    responses and are referred to by none. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    digests = pages.select(
        "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size")
    ).filter(F.col("page_id").isNotNull() & (F.col("size") >= least_revisit))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    # Only revisits are looked up, by page; the large payloads move once.
    revisits = digests.join(firsts.select("digest", "first"), "digest").filter("page_id > first")
    revisits = revisits.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    sized = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    ready = sized.join(revisits, ["page_id", "digest"], "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"),
        "refers_to",
    )
    return stored(ready.mapInArrow(_write_rows(folder, archive_bytes), "archive string"))


def _normalise_rows(source: str, target: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), (to, to_root) = filesystem(source), filesystem(target)
        to.create_dir(to_root, recursive=True)
        for batch in batches:
            done = []
            for archive in batch.column("archive").to_pylist():
                name = f"{uuid4().hex}.warc.gz"
                at = 0
                with (
                    store.open_input_stream(f"{root}/{archive}", compression=None) as file,
                    to.open_output_stream(f"{to_root}/{name}", compression=None) as out,
                    to.open_output_stream(f"{to_root}/{name}.index", compression=None) as index,
                ):
                    for headers, raw in records(inflated(file)):
                        zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zipped.compress(raw) + zipped.flush()
                        out.write(member)
                        index.write(json.dumps({"id": headers["WARC-Record-ID"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at += len(member)
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    return rows


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the ``archives`` of folder ``source`` in ``target``, each with its index: (archive)."""
    spread = archives.repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("archive"))
    return stored(spread.mapInArrow(_normalise_rows(source, target), "archive string"))


def index(archives: DataFrame, folder: str) -> DataFrame:
    """Places of all records of normalised ``archives``: (archive, id, offset, length)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{archive}.index", compression=None) as file:
                    found = [json.loads(line) for line in file.read().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([archive] * len(found), pa.string()),
                        pa.array([x["id"] for x in found], pa.string()),
                        pa.array([x["offset"] for x in found], pa.int64()),
                        pa.array([x["length"] for x in found], pa.int64()),
                    ],
                    ["archive", "id", "offset", "length"],
                )

    return archives.mapInArrow(rows, "archive string, id string, offset bigint, length bigint")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Each record that ``places`` (archive, offset, length) names, inflated from its own member.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, payload); the payload of a revisit is null.
    """

    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def whole(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], list(names))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        opened, file = None, None
        found, held = [], 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["archive"] != opened:
                opened, file = row["archive"], store.open_input_file(f"{root}/{row['archive']}")
            file.seek(row["offset"])
            ((headers, raw),) = records(inflated(pa.BufferReader(file.read(row["length"]))))
            kind = headers["WARC-Type"]
            payload = raw[raw.index(b"\r\n\r\n") + 4 : -4]
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
            number = headers["WARC-Record-ID"][len("<urn:page:") : -1]
            refers = headers.get("WARC-Refers-To")
            found.append(
                (
                    int(number) if number else None,
                    int(headers["X-Payload-Length"]),
                    digest,
                    kind,
                    int(refers[len("<urn:page:") : -1]) if refers else None,
                    payload if kind == "response" else None,
                )
            )
            held += len(payload)
            if held > CHUNK_BYTES:
                yield whole(found)
                found, held = [], 0
        if found:
            yield whole(found)

    return places.select("archive", "offset", "length").mapInArrow(
        rows,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary",
    )


SQL = f"""
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> lead THEN lead END AS refers_to
    FROM (
        SELECT page_id, html,
               CASE WHEN octet_length(encode(html)) >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS lead
        FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
    )
"""
