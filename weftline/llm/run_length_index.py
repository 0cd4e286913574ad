"""Exact removal of long repeated byte strings, found through run-length indexes.

Every string of ``length`` bytes has a smallest ``seed``-byte substring hash, its key. Equal strings
have equal keys, so strings only need to be compared within a key. Consecutive strings of a text with
one key form a segment. Most segments settle by counting: a key seen once holds no repeat, and
segments with equal contents repeat as a whole. For the rest, each task builds a run-length
Burrows-Wheeler index over segments of whole keys, and streams the longest match elsewhere of every
position off the samples at the ends of its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import splittable, stored
from weftline.llm.textarrays import BYTE_CODES, chunks, mix, ranges, rolling_hashes, span_hashes, text_bytes, window_minima

LENGTH = 200
SEED = 32
#: Keys with more distinct segments than this are split further, by the hash of each whole string.
KEY_SEGMENTS = 2000
#: Bytes of segments that one index is built over; the segments of a key stay together.
INDEX_BYTES = 1 << 20
_OTHER_CODES = mix(BYTE_CODES)

_SEGMENTS = "doc_id bigint, start bigint, size bigint, key bigint, content bigint, tied boolean"


def segments(
    data: np.ndarray, offsets: np.ndarray, length: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of each text: (text, start in the bytes of all, size, key, tied).

    ``tied`` tells that the key's seed lies in the segment more than once, so that strings of the
    segment may repeat within it.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    window = length - seed + 1
    seeds = rolling_hashes(BYTE_CODES[data], seed)
    keys = window_minima(seeds, window)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(keys)]
    inside = np.arange(length, length + len(keys)) <= offsets[1:][text]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    heads = np.flatnonzero(new)
    strings = np.diff(np.append(heads, len(keys)))
    heads, strings = heads[inside[heads]], strings[inside[heads]]
    # A seed is the key of a string around it exactly if it is the largest key around it.
    edge = np.zeros(window - 1, np.uint64)
    largest = ~window_minima(~np.concatenate([edge, keys, edge]), window)
    anchors = np.flatnonzero(largest == seeds)
    low = np.searchsorted(anchors, heads)
    run, place = ranges(np.searchsorted(anchors, heads + strings + window - 1) - low)
    hits = seeds[anchors[low[run] + place]] == keys[heads][run]
    tied = np.bincount(run[hits], minlength=len(heads)) > 1
    return text[heads], heads, strings + length - 1, keys[heads], tied


def _segment_rows(length: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                text, start, size, key, tied = segments(data, offsets, length, seed)
                content = span_hashes(_OTHER_CODES[data], start, start + size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(text)),
                        pa.array(start - offsets[text]),
                        pa.array(size),
                        pa.array(key.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array(tied),
                    ],
                    ["doc_id", "start", "size", "key", "content", "tied"],
                )

    return rows


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of the back-to-back texts that end at ``ends``, sorted; each text ends in a symbol of its own.

    Prefix doubling; suffixes that are already alone drop out.
    """
    n = len(data)
    rank = data.astype(np.int64) + 1 + len(ends)
    rank[ends - 1] = 1 + np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    low = rank[order]
    group = np.maximum.accumulate(np.where(np.append(True, low[1:] != low[:-1]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    alone = np.append(group[1:] != group[:-1], True) & np.append(True, group[1:] != group[:-1])
    open_rows = np.flatnonzero(~alone)
    step = 1
    while len(open_rows):
        # Rows of a group are adjacent; only their order within the group changes.
        at = order[open_rows]
        key = rank[at] * np.int64(n + 1) + rank[np.minimum(at + step, n - 1)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_rows] = at
        new = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(new, open_rows, 0))
        rank[at] = group
        keep = ~(new & np.append(new[1:], True))
        open_rows = open_rows[keep]
        step *= 2
    return order


def _common(data: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, both short of their end symbols."""
    most = np.minimum(stops[a] - a, stops[b] - b)
    same = np.zeros(len(a), np.int64)
    rows, width = np.arange(len(a)), 16
    while len(rows):
        reach = np.minimum(same[rows, None] + np.arange(width), np.maximum(most[rows, None] - 1, 0))
        equal = data[a[rows, None] + reach] == data[b[rows, None] + reach]
        equal &= same[rows, None] + np.arange(width) < most[rows, None]
        count = np.where(equal.all(1), width, equal.argmin(1))
        same[rows] += count
        rows = rows[(count == width) & (same[rows] < most[rows])]
    return same


def longest_elsewhere(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of texts back to back: length of its longest match that starts anywhere else.

    ``data`` holds a filler byte as the last of each text, in the place of its end symbol. The
    suffix order is reduced to the runs of its Burrows-Wheeler transform; only suffixes at the
    ends of runs keep a sample, the length they share with the neighbour beyond the run. Inside
    a run both neighbours are preceded by the same byte, so a position shares with its
    neighbour one byte less than the position before it did. The matching statistics stream
    through the text from sample to sample this way.
    """
    n = len(data)
    order = suffix_order(data, ends)
    starts = np.append(0, ends[:-1])
    stops = np.repeat(ends - 1, np.diff(np.append(0, ends)))
    before = data[order - 1].astype(np.int64)
    opens = np.zeros(n, bool)
    opens[starts] = True
    first = np.flatnonzero(opens[order])
    before[first] = 256 + first  # no byte stands before a text, so it joins no run
    heads = np.flatnonzero(before[1:] != before[:-1]) + 1
    shared = _common(data, stops, order[heads - 1], order[heads])
    longest = np.zeros(n, np.int64)
    for sampled, outermost in ((order[heads], order[0]), (order[heads - 1], order[-1])):
        sample, here = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sample[sampled] = shared
        here[sampled] = sampled
        here[outermost] = outermost  # it has no neighbour on this side
        last = np.maximum.accumulate(here)
        longest = np.maximum(longest, sample[last] - (np.arange(n) - last))
    return longest


def _spans(marked: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start at the ``marked`` positions."""
    if not len(marked):
        return []
    cut = np.flatnonzero(np.diff(marked) > length)
    return list(zip(marked[np.append(0, cut + 1)].tolist(), (marked[np.append(cut, len(marked) - 1)] + length).tolist()))


def _index_rows(length: int):
    def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(text + b"\0" for _, _, text in rows), np.uint8)
        sizes = np.array([len(text) + 1 for _, _, text in rows])
        ends = np.cumsum(sizes)
        longest = longest_elsewhere(data, ends)
        spans = []
        for end, size in zip(ends, sizes):
            spans.append(_spans(np.flatnonzero(longest[end - size : end] >= length), length))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key for key, _, _ in rows], pa.int64()),
                pa.array([content for _, content, _ in rows], pa.int64()),
                pa.array([[{"from": a, "to": b} for a, b in x] for x in spans], _SPAN_ARROW),
            ],
            ["key", "content", "spans"],
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "bytes"))):
                if held > INDEX_BYTES and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield flush(rows)

    return index


_SPAN = "array<struct<from:bigint,to:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            raw, out = data.tobytes(), ([], [], [], [])
            for at, asked in zip(offsets.tolist(), part.column("asked").to_pylist()):
                for row in asked:
                    out[0].append(row["key"])
                    out[1].append(row["content"])
                    out[2].append(row["crowded"])
                    out[3].append(raw[at + row["start"] : at + row["start"] + row["size"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                ["key", "content", "crowded", "bytes"],
            )


def _strings(length: int):
    """One row for each whole string of a segment: (key, content, at, two hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "bytes", 1 << 18):
                data, offsets = text_bytes(part.column("bytes"))
                sizes = np.diff(offsets) - length + 1
                segment, at = ranges(sizes)
                whole = offsets[segment] + at
                high = span_hashes(BYTE_CODES[data], whole, whole + length)
                low = span_hashes(_OTHER_CODES[data], whole, whole + length)
                take = pa.array(segment)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(take),
                        part.column("content").take(take),
                        pa.array(at),
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                    ],
                    ["key", "content", "at", "high", "low"],
                )

    return rows


def _mark(length: int):
    """Spans from the list of repeated strings of a segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"from": a, "to": b} for a, b in _spans(np.sort(np.array(at, np.int64)), length)]
                for at in batch.column("at").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("content"), pa.array(spans, _SPAN_ARROW)],
                ["key", "content", "spans"],
            )

    return rows


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    runs: list[list[int]] = []
    for a, b in sorted((x["from"], x["to"]) for x in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [tuple(x) for x in runs]


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {name: [] for name in ("n_bytes", "spans", "kept")}
        for part in chunks(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            raw = data.tobytes()
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("spans").to_pylist()):
                runs, kept, at = _merged(spans or []), [], a
                for x, y in runs:
                    kept.append(raw[at : a + x])
                    at = a + y
                kept.append(raw[at:b])
                rows["n_bytes"].append(b - a)
                rows["spans"].append([{"from": x, "to": y} for x, y in runs])
                rows["kept"].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(rows["n_bytes"], pa.int64()),
                pa.array(rows["spans"], _SPAN_ARROW),
                pa.array(rows["kept"], pa.binary()),
            ],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, key_segments: int = KEY_SEGMENTS
) -> DataFrame:
    """Spans of bytes covered by a ``length``-byte string that also starts elsewhere: (doc_id, spans).

    ``docs`` has the columns doc_id and text. Spans of one document may overlap; documents without
    any are left out. Keys and contents are 64-bit hashes, taken as equal only together.
    """
    found = docs.mapInArrow(_segment_rows(length, seed), _SEGMENTS)
    keys = (
        found.groupBy("key")
        .agg(
            F.count("*").alias("total"),
            F.max("tied").alias("any_tied"),
            (F.min("content") != F.max("content")).alias("differ"),
        )
        .filter("total > 1 OR any_tied")
        .select("key", (F.col("differ") | F.col("any_tied")).alias("mixed"))
    )
    # Occurrences whose key is seen again: all that follows works on these alone.
    known = stored(found.drop("tied").join(splittable(keys, "key"), "key"))
    contents = known.groupBy("key", "content", "mixed").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "start", "size")).alias("at")
    )
    crowded = (
        contents.filter("mixed").groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") > key_segments).alias("crowded"))
    )
    # A content with copies repeats as a whole. Its bytes may still hold strings of other contents.
    asked = (
        contents.filter("mixed")
        .join(splittable(crowded, "key"), "key")
        .select("at.doc_id", F.struct("at.start", "at.size", "key", "content", "crowded").alias("asked"))
        .groupBy("doc_id")
        .agg(F.collect_list("asked").alias("asked"))
    )
    compared = docs.join(asked, "doc_id").mapInArrow(
        _cut_segments, "key bigint, content bigint, crowded boolean, bytes binary"
    )
    by_index = (
        compared.filter("NOT crowded")
        .select("key", "content", "bytes")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_index_rows(length), f"key bigint, content bigint, spans {_SPAN}")
    )
    # Strings of crowded keys meet by their own hashes, which spread evenly.
    strings = compared.filter("crowded").mapInArrow(
        _strings(length), "key bigint, content bigint, at bigint, high bigint, low bigint"
    )
    often = strings.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    by_string = (
        strings.join(often, ["high", "low"])
        .groupBy("key", "content")
        .agg(F.collect_list("at").alias("at"))
        .mapInArrow(_mark(length), f"key bigint, content bigint, spans {_SPAN}")
    )
    whole = contents.filter("copies > 1").select(
        "key",
        "content",
        F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("at.size").alias("to"))).alias("spans"),
    )
    marks = whole.unionByName(by_index.unionByName(by_string).filter(F.size("spans") > 0))
    return (
        known.join(marks, ["key", "content"])
        .select(
            "doc_id",
            F.transform(
                "spans", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to"))
            ).alias("spans"),
        )
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, key_segments: int = KEY_SEGMENTS
) -> DataFrame:
    """Each document without the bytes of strings that repeat: (doc_id, n_bytes, spans, kept).

    Texts are UTF-8 bytes; matches never cross documents; a null is an empty text and shorter texts
    than ``length`` stay whole. Every occurrence goes, the first included. ``doc_id`` should be unique
    and not null; rows that repeat a doc_id each count as a document for the matches, and a
    span found in one of them is cut from all. Rows with a null doc_id are given back whole and
    match nothing.
    Other columns of ``docs`` are ignored.
    """
    plain = docs.select("doc_id", "text")
    known = plain.filter(F.col("doc_id").isNotNull())
    spans = repeated_spans(known, length, seed, key_segments)
    none = plain.filter(F.col("doc_id").isNull()).withColumn("spans", F.lit(None).cast(_SPAN))
    return (
        known.join(spans, "doc_id", "left")
        .unionByName(none)
        .mapInArrow(_cut_texts, f"doc_id bigint, n_bytes bigint, spans {_SPAN}, kept binary")
    )


SQL = f"""
    WITH texts AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), strings AS (
        SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM texts)
    ), repeats AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM strings) WHERE n > 1
    ), numbered AS (
        SELECT doc_id, i, sum(CASE WHEN i - before <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeats)
    ), spans AS (
        SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY doc_id, span
    ), pieces AS (
        SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low FROM spans
    ), kept AS (
        SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last,
               string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS front
        FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
"""
