"""Token ids in files of fixed-width bits, in the order of the documents, with random access.

An id takes as many bits as the largest id of the vocabulary. A file holds blocks of ``BLOCK`` ids, so that each begins at
a byte; after them the offsets of the blocks, the document ids and the first id of each document; then
a trailer of fixed size. Ids are packed and unpacked many at a time with numpy.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.library_tokens import CHUNK, SpanCache, joined_ids, library_tokenizer
from weftline.llm.spill import filesystem, stored
from weftline.llm.textarrays import chunks, ranges, text_bytes, words

END = 1
#: Ids in a block; a multiple of 8, so that a block fills whole bytes at any width.
BLOCK = 4096
#: Ids after which a task starts another file, and ids that are read at a time.
FILE_IDS, READ_IDS = 1 << 26, 1 << 19
MAGIC = b"FIXBITS1"
#: Offset of the tables, ids, documents, ids in a block, bits of an id, magic.
TRAILER = struct.Struct("<QQQII8s")


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after another, the highest bit of each first; zeros fill the last byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(rows).tobytes()


def unpack_ids(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``raw``."""
    rows = np.zeros((n, 32), np.uint8)
    rows[:, 32 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(rows).view(">u4").astype(np.uint32)


class Writer:
    """Writes ids document by document to ``file``; holds one block of ids and the table of documents."""

    def __init__(self, file: BinaryIO, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = file, bits, block
        self.at, self.n = 0, 0
        self.rest = np.zeros(0, np.uint32)
        self.offsets: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, docs: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the number of ids of each, and their ids back to back."""
        self.docs.append(docs.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.sizes.append(sizes.astype("<i8"))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        self._write(ids[:whole])
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        size = self.block * self.bits // 8
        self.offsets.append(self.at + size * np.arange(-(-len(ids) // self.block)))
        raw = pack_ids(ids, self.bits)
        self.file.write(raw)
        self.at += len(raw)

    def finish(self) -> None:
        self._write(self.rest)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        docs, sizes = join(self.docs, "<i8"), join(self.sizes, "<i8")
        tables = (np.append(join(self.offsets, "<i8"), self.at), docs, np.append(0, np.cumsum(sizes)))
        for table in tables:
            self.file.write(table.astype("<i8").tobytes())
        self.file.write(np.packbits(join(self.nulls, np.uint8)).tobytes())
        self.file.write(TRAILER.pack(self.at, self.n, len(docs), self.block, self.bits, MAGIC))


class Reader:
    """Ids of a file by place or by document; of the blocks, only those asked for are read."""

    def __init__(self, file: BinaryIO, size: int):
        self.file = file
        file.seek(size - TRAILER.size)
        at, self.n, docs, self.block, self.bits, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("this is no file of packed ids")
        file.seek(at)
        blocks = -(-self.n // self.block)
        values = np.frombuffer(file.read(8 * (blocks + 1 + docs + docs + 1)), "<i8")
        self.offsets, self.docs, self.first = np.split(values, [blocks + 1, blocks + 1 + docs])
        self.nulls = np.unpackbits(np.frombuffer(file.read(-(-docs // 8)), np.uint8), count=docs).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` up to ``stop``."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError("no such ids")
        if start == stop:
            return np.zeros(0, np.uint32)
        low, high = start // self.block, -(-stop // self.block)
        self.file.seek(int(self.offsets[low]))
        raw = self.file.read(int(self.offsets[high] - self.offsets[low]))
        return unpack_ids(raw, self.bits, min(self.n, high * self.block) - low * self.block)[start - low * self.block : stop - low * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the document at place ``k``."""
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


@functools.cache
def _encoder(path: str) -> tuple[SpanCache, re.Pattern[bytes] | None]:
    tokenizer = library_tokenizer(path)
    added = [re.escape(x.content.encode()) for x in tokenizer.get_added_tokens_decoder().values()]
    return SpanCache(partial(joined_ids, tokenizer)), re.compile(b"|".join(added), re.IGNORECASE) if added else None


def parts(data: np.ndarray, offsets: np.ndarray, kept: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``data`` in lower case as far as that is safe; start and end byte of each part, and the index of each text's first (one more at the end).

    Parts are words, cut further between ASCII characters that the tokenizer's pattern never joins: letters, single digits
    and others, but not after an apostrophe, which may begin a contraction. A letter before a
    character beyond ASCII keeps its case, since the two may be composed first. Nothing in the ``kept`` spans changes.
    """
    starts, _, _ = words(data, offsets)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    kind = np.select([data >= 128, space, letter, digit], [0, 1, 2, 3], 4).astype(np.int8)
    cut = np.zeros(len(data) + 1, bool)
    before, after = kind[:-1], kind[1:]
    cut[1:-1] = (before > 1) & (after > 1) & ((before != after) | (after == 3)) & (data[:-1] != 39)
    cut[starts] = True
    last = np.ones(len(data), bool)
    last[:-1] = data[1:] < 128
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    lower = (kind == 2) & last
    for a, b in kept:
        cut[a + 1 : b] = False
        lower[a:b] = False
    starts = np.flatnonzero(cut)
    # A part ends where the next one or white space begins, or its text ends.
    stop = cut.copy()
    stop[:-1] |= space
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return np.where(lower, data | 32, data), starts, ends, np.searchsorted(starts, offsets)


def text_ids(path: str, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, each followed by ``end``, and the number of ids of each.

    The tokenizer drops white space, folds case and splits at kinds of characters, so that parts of words have their ids by
    themselves; see ``parts``. The file's added tokens stay whole.
    """
    data, offsets = text_bytes(column)
    cache, added = _encoder(path)
    kept = [x.span() for x in added.finditer(data.tobytes())] if added else []
    data, starts, ends, first = parts(data, offsets, kept)
    ids, bounds = cache.ids(data, starts, ends)
    sizes = np.diff(bounds[first])
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    text, place = ranges(sizes)
    out[(np.cumsum(sizes + 1) - sizes - 1)[text] + place] = ids
    return out, sizes + 1


FILES = "part int, number int, file string, n_ids bigint"


def _write_rows(folder: str, path: str, bits: int, end: int, file_ids: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        part, done, out, writer = TaskContext.get().partitionId(), [], None, None

        def close() -> None:
            writer.finish()
            out.close()
            done.append((part, len(done), name, writer.n))

        for piece in (piece for batch in batches for piece in chunks(batch, "text", CHUNK)):
            if writer is None:
                # A task that runs again writes names of its own; only files that a finished task names are read.
                name = f"{uuid4().hex}.ids"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = Writer(out, bits)
            ids, sizes = text_ids(path, piece.column("text"), end)
            docs = piece.column("doc_id")
            writer.add(docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False), sizes, ids)
            if writer.n >= file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        columns = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["part", "number", "file", "n_ids"])

    return rows


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts, each followed by ``end``, to files in ``folder``: (file, n_ids, base).

    ``path`` names a file of the tokenizers library whose tokenizer drops white space, folds case and splits letters, digits
    and other characters; every executor and the driver
    have it. Documents are written by ascending doc_id, nulls first; ``base`` is the number of ids in all files
    before. Rows that repeat a doc_id are each written, by a hash of their text. A null is an empty text, which
    is ``end`` alone. Other columns are ignored. An empty table writes no file.
    """
    spark = docs.sparkSession
    bits = bits_for(max(library_tokenizer(path).get_vocab_size(with_added_tokens=True), end + 1))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    # The texts move once. Only rows that are equal in doc_id and text are told apart by their place in the table.
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_hash", "_row")
    ordered = ranged.sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")
    files = stored(ordered.mapInArrow(_write_rows(folder, path, bits, end, file_ids), FILES))
    # One row for each file of up to ``file_ids`` ids.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("base"))


def read_ids(files: DataFrame, folder: str, read: int = READ_IDS) -> DataFrame:
    """Every document of ``files`` (file, base) in ``folder``: (doc_id, start, n_tokens, ids).

    ``start`` counts the ids of all documents before, over all files; ids are little-endian unsigned 32-bit integers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for file, base in ((x["file"], x["base"]) for batch in batches for x in batch.to_pylist()):
            with store.open_input_file(f"{root}/{file}") as source:
                reader = Reader(source, source.size())
                low = 0
                while low < len(reader.docs):
                    high = max(low + 1, int(np.searchsorted(reader.first, reader.first[low] + read, "right")) - 1)
                    first = reader.first[low : high + 1]
                    raw = reader.ids(int(first[0]), int(first[-1])).astype("<u4").tobytes()
                    cuts = (4 * (first - first[0])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs[low:high].astype(np.int64), mask=reader.nulls[low:high]),
                            pa.array(first[:-1].astype(np.int64) + base),
                            pa.array(np.diff(first).astype(np.int64)),
                            pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    low = high

    spread = files.select("file", "base").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("file"))
    return spread.mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
