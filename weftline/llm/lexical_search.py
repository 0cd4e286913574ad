"""Ranked lexical search: the best documents for each query, by lists of short terms first and long ones after.

One pass cuts the documents into segments and writes each segment's inverted index of the terms that queries use, with
the counts of the whole table. Then every segment answers every query: the short lists of a query
are summed up term at a time, their sums form one list with a bound of its own, and that list and the
long ones are walked document at a time, in batches. A long list whose bound and those below
it cannot lift a document into the best ones is only looked up for documents that others bring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.spill import stored
from weftline.llm.textarrays import byte_hashes, byte_runs, chunks, equal_spans, text_bytes

BEST = 10
#: Bytes of text in a segment, and of the queries that are answered together.
SEGMENT, QUERY_BYTES = 4 << 20, 4 << 20
#: A list is short if it holds at most one of so many documents of its segment.
SHORT = 16
#: Documents walked at a time.
BATCH = 1024
#: Parts in which the best documents of a query are found before they meet.
SALTS = 64

_KEPT = np.array([not (c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F) for c in range(256)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A to Z in lower case, start and end of each term, and the index of each text's first (one more at the end)."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    return data, *byte_runs(_KEPT[data], offsets)


@dataclass
class Queries:
    """Some queries and the distinct terms they use, ordered by hash: the terms of each query are numbers of these."""

    ids: list[int | None]
    terms: list[list[int]]
    words: list[bytes]
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Queries:
        data, starts, ends, first = terms(pa.array(texts, pa.string()))
        raw = data.tobytes()
        found = [{raw[a:b] for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist())} for x, y in zip(first, first[1:])]
        words = sorted(set().union(*found))
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        hashes = byte_hashes(data, starts, starts + lengths)
        order = np.argsort(hashes, kind="stable")
        place = {words[i]: k for k, i in enumerate(order.tolist())}
        return cls(ids, [sorted(place[w] for w in x) for x in found], [words[i] for i in order], hashes[order], data, starts[order], lengths[order])

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, or -1 if no query has it."""
        number = np.full(len(starts), -1, np.int64)
        if not len(self.words):
            return number
        hashes, lengths = byte_hashes(data, starts, ends), ends - starts
        both, shift = np.concatenate([self.data, data]), len(self.data)
        low = np.searchsorted(self.hashes, hashes)
        at = np.flatnonzero(low < len(self.words))
        at = at[self.hashes[low[at]] == hashes[at]]
        while len(at):  # terms of equal hashes stand side by side and are told apart by their bytes
            k = low[at]
            same = (self.lengths[k] == lengths[at]) & equal_spans(both, self.starts[k], starts[at] + shift, np.minimum(self.lengths[k], lengths[at]))
            number[at[same]] = k[same]
            at = at[~same]
            low[at] += 1
            at = at[low[at] < len(self.words)]
            at = at[self.hashes[low[at]] == hashes[at]]
        return number


SEGMENTS = "doc_id array<bigint>, n array<bigint>, term array<bigint>, bounds array<bigint>, place binary, tf binary, with_term bigint, n_terms bigint"


def _index_rows(queries: Queries, segment: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", segment):
                data, starts, ends, first = terms(part.column("text"))
                n = np.diff(first)
                number = queries.numbers(data, starts, ends)
                used = np.flatnonzero(number >= 0)
                place = np.searchsorted(first, used, "right") - 1
                posting, tf = np.unique(number[used] * len(n) + place, return_counts=True)
                term, bounds = np.unique(posting // len(n), return_index=True)
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(part.column("doc_id").to_pylist(), pa.list_(pa.int64())),
                        one(n, pa.list_(pa.int64())),
                        one(term, pa.list_(pa.int64())),
                        one(np.append(bounds, len(posting)), pa.list_(pa.int64())),
                        one((posting % len(n)).astype("<u4").tobytes(), pa.binary()),
                        one(tf.astype("<u4").tobytes(), pa.binary()),
                        one(int((n > 0).sum()), pa.int64()),
                        one(int(n.sum()), pa.int64()),
                    ],
                    ["doc_id", "n", "term", "bounds", "place", "tf", "with_term", "n_terms"],
                )

    return rows


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, total: int, all_terms: int) -> np.ndarray:
    """What an occurrence of ``tf`` times in a document of ``n`` terms adds to its score."""
    m = 100 - 90 + 90 * n * total // max(all_terms, 1)
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


@dataclass
class Postings:
    """Places of documents in order, what each adds to its score, and the most that one adds."""

    places: np.ndarray
    scores: np.ndarray
    bound: int


def summed(lists: list[Postings]) -> Postings:
    """The sums of several lists, document by document."""
    places = np.concatenate([x.places for x in lists])
    order = np.argsort(places, kind="stable")
    places = places[order]
    new = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    scores = np.add.reduceat(np.concatenate([x.scores for x in lists])[order], new)
    return Postings(places[new], scores, int(scores.max()))


class Best:
    """The best documents so far of one query: by score, then by doc_id, nulls last."""

    def __init__(self, most: int):
        self.most = most
        self.found: list[tuple[int, bool, int]] = []

    @property
    def least(self) -> int:
        """The least score that may still be taken; equal scores are, since a smaller doc_id may follow."""
        return -self.found[-1][0] if len(self.found) == self.most else 1

    def add(self, scores: list[int], docs: list[int | None]) -> None:
        new = ((-s, d is None, d or 0) for s, d in zip(scores, docs))
        self.found = sorted([*self.found, *new])[: self.most]


def walk(lists: list[Postings], n: int, best: Best, docs: list[int | None], short: int = SHORT, batch: int = BATCH) -> None:
    """Add to ``best`` what the ``lists`` of a query's terms in a segment of ``n`` documents find."""
    few = [x for x in lists if len(x.places) * short <= n]
    walked = [x for x in lists if len(x.places) * short > n]
    if few:
        walked.append(summed(few))
    walked.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in walked]).tolist()  # the most that a list and those before it add together
    at = [0] * len(walked)
    for stop in range(batch, n + batch, batch):
        least = best.least
        # The first lists alone cannot reach the best; only the others bring documents up.
        bringing = next((i for i, x in enumerate(reach) if x >= least), None)
        if bringing is None:
            return
        parts = []
        for i in range(bringing, len(walked)):
            x = walked[i]
            end = int(np.searchsorted(x.places, stop))
            if end > at[i]:
                parts.append(Postings(x.places[at[i] : end], x.scores[at[i] : end], 0))
            at[i] = end
        if not parts:
            continue
        found = summed(parts)
        places, scores = found.places, found.scores
        for i in range(bringing - 1, -1, -1):
            hopeful = scores + reach[i] >= least
            places, scores = places[hopeful], scores[hopeful]
            if not len(places):
                break
            x = walked[i]
            # Skips to each document; what lies between is never read.
            k = np.minimum(np.searchsorted(x.places, places), len(x.places) - 1)
            scores = scores + np.where(x.places[k] == places, x.scores[k], 0)
        hopeful = scores >= least
        places, scores = places[hopeful], scores[hopeful]
        if len(places) > best.most:
            cut = np.partition(scores, len(scores) - best.most)[-best.most]
            places, scores = places[scores >= cut], scores[scores >= cut]
        if len(places):
            best.add(scores.tolist(), [docs[i] for i in places.tolist()])


def _search_rows(queries: Queries, block: int, df: dict[int, int], total: int, all_terms: int, most: int, short: int, batch_docs: int):
    weights = np.array([weight(total, df.get(i, 0)) for i in range(len(queries.words))], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(most) for _ in queries.ids]
        for batch in batches:
            for k in range(batch.num_rows):
                x = {name: batch.column(name)[k] for name in ("doc_id", "n", "term", "bounds", "place", "tf")}
                n, term, bounds = (x[name].values.to_numpy() for name in ("n", "term", "bounds"))
                place, tf = (np.frombuffer(x[name].as_py(), "<u4").astype(np.int64) for name in ("place", "tf"))
                if not len(term):
                    continue
                docs = x["doc_id"].as_py()
                sizes = np.diff(bounds)
                scores = impacts(np.repeat(weights[term], sizes), tf, n[place], total, all_terms)
                most_of = np.maximum.reduceat(scores, bounds[:-1])
                lists = {
                    t: Postings(place[a:b], scores[a:b], m)
                    for t, a, b, m in zip(term.tolist(), bounds.tolist(), bounds[1:].tolist(), most_of.tolist())
                    if m > 0
                }
                for best, wanted in zip(found, queries.terms):
                    if own := [lists[t] for t in wanted if t in lists]:
                        walk(own, len(n), best, docs, short, batch_docs)
        part = TaskContext.get().partitionId() % SALTS
        out = [(block, i, part, item, None if none else doc, -score) for i, (item, x) in enumerate(zip(queries.ids, found)) for score, none, doc in x.found]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["block", "item", "part", "item_id", "doc_id", "score"])

    return rows


FOUND = "block int, item int, part int, item_id bigint, doc_id bigint, score bigint"


def query_blocks(items: DataFrame, size: int = QUERY_BYTES) -> list[list[int]]:
    """Parts of ``items``, by a hash, that are answered together: about ``size`` bytes of text each. Parts are numbers below their total, the last value."""
    whole = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = 1 + 16 * whole // size
    sizes = dict(_part(items, parts).groupBy("_part").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).collect())
    blocks: list[list[int]] = []
    held = size
    for part in sorted(sizes):
        if held + sizes[part] > size:
            blocks.append([])
            held = 0
        blocks[-1].append(part)
        held += sizes[part]
    return [[*block, parts] for block in blocks]


def _part(items: DataFrame, parts: int) -> DataFrame:
    return items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))


def search(
    docs: DataFrame,
    items: DataFrame,
    most: int = BEST,
    segment: int = SEGMENT,
    query_bytes: int = QUERY_BYTES,
    short: int = SHORT,
    batch: int = BATCH,
) -> DataFrame:
    """The ``most`` best documents of each row of ``items`` (item_id, text): (item_id, rank, doc_id, score).

    Only scores above 0 count; equal scores go by ascending doc_id, nulls last. Each row of ``docs`` is a document, rows that repeat a
    doc_id too, and each row of ``items`` a query with ranks of its own. A null text, of either, has no terms. Very
    long texts are segments by themselves. Other columns are ignored; without documents or queries there is no row.

    Queries are answered in blocks of ``query_bytes`` bytes of text, so that what a task gets of them is bounded
    however many there are; each block takes one pass over the documents.
    """
    docs, items = docs.select("doc_id", "text"), items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    results = None
    for block, (*parts, of) in enumerate(query_blocks(items, query_bytes)):
        rows = _part(items, of).filter(F.col("_part").isin(parts)).select("item_id", "text").collect()
        queries = Queries.of([x.item_id for x in rows], [x.text for x in rows])
        indexed = stored(docs.mapInArrow(_index_rows(queries, segment), SEGMENTS))
        counts = indexed.agg(F.coalesce(F.sum("with_term"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        sizes = F.transform("term", lambda t, i: F.struct(t.alias("term"), (F.get("bounds", i + 1) - F.get("bounds", i)).alias("df")))
        # At most one row for each term of the block's queries.
        df = indexed.select(F.explode(sizes).alias("x")).groupBy("x.term").agg(F.sum("x.df")).collect()
        found = indexed.mapInArrow(_search_rows(queries, block, dict(map(tuple, df)), counts[0], counts[1], most, short, batch), FOUND)
        results = found if results is None else results.unionByName(found)
    if results is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

    def ranked(frame: DataFrame, *keys: str) -> DataFrame:
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)

    # Tasks bring up to ``most`` rows for each query; they meet in two steps.
    return ranked(ranked(results, "block", "item", "part"), "block", "item").select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"
SQL = f"""
    WITH found AS (
        SELECT doc_id, {_TERMS} AS term FROM documents
    ), postings AS (
        SELECT doc_id, term, count(*) AS tf FROM found GROUP BY doc_id, term
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id
    ), totals AS (
        SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes
    ), frequencies AS (
        SELECT term, count(*) AS df FROM postings GROUP BY term
    ), wanted AS (
        SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)
    ), scored AS (
        SELECT item_id, doc_id,
               sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
        FROM wanted JOIN postings USING (term) JOIN frequencies USING (term) JOIN sizes USING (doc_id), totals
        GROUP BY item_id, doc_id
    ), ranked AS (
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
