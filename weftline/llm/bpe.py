"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

A pre-token that is itself in the vocabulary is found by a minimal perfect hash. The others
are merged byte by byte: the pairs wait in a heap by rank, their parts in a linked list.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.pretokens import pretokens
from weftline.llm.textarrays import byte_hashes, chunks, distinct_spans, mix, ranges, text_bytes

#: Pre-tokens whose ids a Python worker remembers; when full, it starts again.
CACHE = 1 << 19
_BUCKET, _TRIES, _DIRECT = 4, 256, np.uint64(1 << 63)
_WORDS: dict[int, dict[bytes, list[int]]] = {}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a tiktoken file, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens by rank, with a minimal perfect hash over them.

    Tokens fall into small buckets. From the largest bucket on, each gets the first displacement that
    sends its tokens to free slots; there are as many slots as tokens, and each holds its token's rank.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.name = zlib.crc32(b"\0".join(tokens))
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        lengths = np.array([len(x) for x in tokens])
        self.offsets = np.append(0, np.cumsum(lengths))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.keys = byte_hashes(self.data, self.offsets[:-1], self.offsets[1:])
        n = len(tokens)
        self.shift = np.zeros(n // _BUCKET + 1, np.uint64)
        self.slots = np.full(n, -1)
        bucket = (self.keys % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket, minlength=len(self.shift)))[:-1])
        for rows in sorted(members, key=len, reverse=True):
            if len(rows) < 2:
                break
            first, tried, slot = self.keys[rows], np.arange(_TRIES, dtype=np.uint64)[:, None], None
            while slot is None:
                slots = np.sort(self._hashed(first[None, :], tried), axis=1)
                fits = (self.slots[slots] < 0).all(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if fits.any():
                    shift = tried[fits.argmax(), 0]
                    slot = self._hashed(first, shift)
                tried = tried + np.uint64(_TRIES)
            self.shift[bucket[rows[0]]] = shift
            self.slots[slot] = rows
        # A bucket of one token names its slot itself.
        alone = np.array([rows[0] for rows in members if len(rows) == 1], np.int64)
        free = np.flatnonzero(self.slots < 0)
        self.shift[bucket[alone]] = free.astype(np.uint64) | _DIRECT
        self.slots[free] = alone

    def _hashed(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys ^ mix(shift + np.uint64(1))) % np.uint64(len(self.tokens))).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift >= _DIRECT, (shift & ~_DIRECT).astype(np.int64) % len(self.tokens), self._hashed(keys, shift))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token with each hash, or -1."""
        rank = self.slots[self._slot(keys)]
        return np.where(self.keys[rank] == keys, rank, -1)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the adjacent pair of lowest rank, leftmost first, merges until none is left."""
        ranks, n = self.ranks, len(word)
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, stop = heapq.heappop(heap)
            right = end[left]
            if not alive[left] or right >= n or end[right] != stop:
                continue  # one of its parts has merged with another since
            alive[right], end[left] = False, stop
            if stop < n:
                back[stop] = left
                if (r := ranks.get(word[left : end[stop]])) is not None:
                    heapq.heappush(heap, (r, left, end[stop]))
            if left and (r := ranks.get(word[back[left] : stop])) is not None:
                heapq.heappush(heap, (r, back[left], stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> bytes:
        token, place = ranges(np.diff(self.offsets)[ids])
        return self.data[self.offsets[ids][token] + place].tobytes()


def encode_chunk(
    known: Vocabulary, cache: dict[bytes, list[int]], data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and the bounds of each text's."""
    starts, ends, first = pretokens(data, offsets)
    at, hashes, which = distinct_spans(data, starts, ends)
    rank, raw, lists = known.find(hashes), data.tobytes(), []
    for r, a, b in zip(rank.tolist(), starts[at].tolist(), ends[at].tolist()):
        word = raw[a:b]
        if r >= 0 and known.tokens[r] == word:
            lists.append((r,))
            continue
        ids = cache.get(word)
        if ids is None:
            if len(cache) >= CACHE:
                cache.clear()
            ids = cache[word] = known.merge(word)
        lists.append(ids)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for ids in lists for x in ids), np.uint32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    token, place = ranges(sizes[which])
    return flat[begin[which][token] + place], np.append(0, np.cumsum(sizes[which]))[first]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tiktoken file, built once on the driver."""
    return Vocabulary(read_ranks(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each text: (doc_id, n_tokens, ids), ids as little-endian unsigned 32-bit integers.

    ``path`` names a tiktoken file that the driver reads; the vocabulary, of a fixed size, is broadcast.
    A null is an empty text. Every row of ``docs`` gives one row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cache = _WORDS.setdefault(known.name, {})  # lasts as long as the Python worker
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = encode_chunk(known, cache, *text_bytes(part.column("text")))
                raw, cuts = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the bytes that the ids of ``encode`` stand for, as ``decoded``. A null is an empty list of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in chunks(batch, "ids"):
                raw, offsets = text_bytes(part.column("ids"))
                ids, bounds = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), offsets // 4
                texts = known.decode(ids)
                cuts = np.append(0, np.cumsum(np.diff(known.offsets)[ids]))[bounds].tolist()
                decoded = pa.array([texts[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        rows, "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    )
