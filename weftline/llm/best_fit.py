"""Packing token sequences: Martello-Toth dominance reduction, then best fit for the rest.

Only the number of pieces of each length decides the plan, and there are at most as many lengths
as a sequence has tokens. The driver plans over these counts; Spark numbers the pieces of each length
and looks their places up in the plan.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.library_tokens import CHUNK, SpanCache, batch_ids, library_tokenizer
from weftline.llm.pretokens import pretokens
from weftline.llm.spill import stored
from weftline.llm.textarrays import chunks, text_bytes

CAPACITY = 1024
END = 2
_WORKER: dict = {}

#: A run of pieces of one length: those numbered from ``first`` up to ``until`` go ``each`` to a sequence,
#: from ``sequence`` on, the first of each sequence at ``offset``.
PLAN = "length bigint, first bigint, until bigint, sequence bigint, each bigint, offset bigint"


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.done = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, ...]] = []
        self.sequence = 0

    def place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        first = self.done[length]
        self.rows.append((length, first, first + n, sequence, each, offset))
        self.done[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.sizes.remove(length)

    def fix(self, items: list[int], times: int) -> None:
        """``times`` new sequences that each hold ``items``."""
        offset = 0
        for w in dict.fromkeys(items):
            each = items.count(w)
            self.place(w, times * each, self.sequence, each, offset)
            offset += w * each
        self.sequence += times

    def others(self, *taken: int) -> dict[int, int]:
        """Pieces left by length without ``taken``."""
        left = dict(self.left)
        for w in taken:
            left[w] -= 1
        return {w: left[w] for w in self.sizes if left[w]}

    def dominating(self, j: int) -> list[int] | None:
        """A set with a piece of length ``j`` that dominates every other such set, if one can be named.

        A set dominates another if the pieces of the other can be grouped so that each group is
        no longer than a piece of the first, one for one. Some best packing then holds it.
        """
        room, rest = self.capacity - j, self.others(j)
        fitting = [w for w in rest if w <= room]
        if not fitting:
            return [j]
        k = fitting[-1]
        smallest = [w for w in fitting for _ in range(min(rest[w], 3))][:3]
        most = next((i for i in range(len(smallest)) if sum(smallest[: i + 1]) > room), len(smallest))
        if most == 1 or k == room:
            return [j, k]
        if most > 2 or (len(smallest) == 3 and sum(smallest) <= room):
            return None
        # At most two more pieces fit. The longer of two is at most k.
        pairs = [(w + v, w) for i, w in enumerate(fitting) for v in self._partner(fitting, rest, i, room)]
        if max(total for total, _ in pairs) <= k:
            return [j, k]
        after_k = [w for w in self.others(j, k) if w <= room - k]
        if after_k and after_k[-1] >= max(w for _, w in pairs):
            return [j, k, after_k[-1]]
        return None

    @staticmethod
    def _partner(fitting: list[int], rest: dict[int, int], i: int, room: int) -> list[int]:
        """The longest piece to go with the shorter piece ``fitting[i]``, if any does."""
        low = i if rest[fitting[i]] > 1 else i + 1
        high = bisect_left(fitting, room - fitting[i] + 1)
        return [fitting[high - 1]] if high > low else []

    def reduce(self) -> None:
        for j in reversed(list(self.sizes)):
            while self.left[j]:
                items = self.dominating(j)
                if items is None:
                    break
                self.fix(items, min(self.left[w] // items.count(w) for w in items))

    def best_fit(self) -> None:
        """Longest first, each piece to the fullest open sequence that has room."""
        open_by_room: list[tuple[int, int, int]] = []  # (room, first sequence, number of sequences)
        for w in reversed(list(self.sizes)):
            while self.left[w]:
                at = bisect_left(open_by_room, (w,))
                if at == len(open_by_room):
                    each = self.capacity // w
                    room, first, n = self.capacity, self.sequence, -(-self.left[w] // each)
                    self.sequence += n
                else:
                    room, first, n = open_by_room.pop(at)
                each = min(room // w, self.left[w])
                used = min(n, self.left[w] // each)
                self.place(w, used * each, first, each, self.capacity - room)
                if n > used:
                    insort(open_by_room, (room, first + used, n - used))
                if room > each * w:
                    insort(open_by_room, (room - each * w, first, used))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Rows of ``PLAN`` that place all pieces, given how many there are of each length."""
    work = _Plan(counts, capacity)
    work.reduce()
    work.best_fit()
    return work.rows


def _tokenizer(path: str):
    if _WORKER.get("path") != path:
        tokenizer = library_tokenizer(path)
        added = sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        pattern = re.compile(b"|".join(re.escape(x.encode()) for x in added)) if added else None
        _WORKER.update(path=path, tokenizer=tokenizer, cache=SpanCache(partial(batch_ids, tokenizer)), added=pattern)
    return _WORKER["tokenizer"], _WORKER["cache"], _WORKER["added"]


def token_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and the bounds of each text's. Each distinct pre-token is encoded once.

    A text that spells one of the file's added tokens is encoded whole instead, as the plain call does it.
    """
    tokenizer, cache, added = _tokenizer(path)
    starts, ends, first = pretokens(data, offsets)
    ids, bounds = cache.ids(data, starts, ends)
    bounds = bounds[first]
    raw = data.tobytes()
    found = [x.span() for x in added.finditer(raw)] if added else []
    texts = set()
    for a, b in found:
        text = int(np.searchsorted(offsets, a, "right")) - 1
        if b <= offsets[text + 1]:
            texts.add(text)
    if not texts:
        return ids, bounds
    parts = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    for text in texts:
        whole = raw[offsets[text] : offsets[text + 1]].decode()
        parts[text] = np.array(tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
    return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token pieces of each text: (doc_id, piece, start, length, ids_crc32).

    ``end`` follows the ids of each text. What is longer than ``capacity`` is cut so that all pieces but
    the first are full. ``path`` names a file of the tokenizers library that every executor has.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                ids, bounds = token_ids(path, *text_bytes(part.column("text")))
                out = ([], [], [], [], [])
                for text, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    raw = np.append(ids[a:b], np.uint32(end)).astype("<u4").tobytes()
                    length = b - a + 1
                    at, stop = 0, (length - 1) % capacity + 1
                    for piece in range(-(-length // capacity)):
                        for values, x in zip(out, (text, piece, at, stop - at, zlib.crc32(raw[4 * at : 4 * stop]))):
                            values.append(x)
                        at, stop = stop, stop + capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(out[0], pa.int64())),
                        pa.array(out[1], pa.int32()),
                        *(pa.array(x, pa.int64()) for x in out[2:]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``found``, rows with a ``length`` from 1 to ``capacity``."""
    spark = found.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(found.withColumn("_salt", F.pmod(F.xxhash64(*found.columns), F.lit(salts))))
    by_salt = found.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # At most ``capacity`` rows reach the driver.
    counts = by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    places = spark.createDataFrame(plan({r.length: r.n for r in counts}, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = by_salt.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # A length that most pieces have is numbered in as many parts as there are salts.
    within = Window.partitionBy("length", "_salt").orderBy(*[c for c in found.columns if c not in ("length", "_salt")])
    numbered = found.withColumn("_rank", F.row_number().over(within) - 1).join(by_salt, ["length", "_salt"])
    numbered = numbered.withColumn("_rank", F.col("_rank") + F.col("_before")).alias("piece")
    places = F.broadcast(places.alias("place"))
    at = F.col("_rank") - F.col("place.first")
    return numbered.join(
        places,
        (F.col("piece.length") == F.col("place.length"))
        & (F.col("_rank") >= F.col("place.first"))
        & (F.col("_rank") < F.col("place.until")),
    ).select(
        *[F.col(f"piece.{c}") for c in found.columns if c != "_salt"],
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("place.offset") + at % F.col("each") * F.col("piece.length")).alias("offset"),
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every text with its place in the packed sequences.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null is an empty text, which is
    the id ``end`` alone. Each row of ``docs`` counts, rows that repeat a doc_id too; other columns
    are ignored. An empty table gives no row.
    """
    return pack(pieces(docs, path, capacity, end), capacity)
