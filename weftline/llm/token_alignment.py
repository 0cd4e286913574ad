"""Two tokenizers' tokens of the same texts, aligned by diagonal run skipping.

Both token sequences of a text are arrays of byte ends. Where their ends are equal index by index, at the current shift between
the two indices, whole stretches of one-to-one tokens are jumped, after windows of doubling width. Where they differ, a
group of several tokens is walked to the next common end, which gives the new shift. Long texts
are cut at places where words begin in both, and numpy works on all these lanes of a chunk in step.

How often two ids are linked is counted over the whole table: each chunk sends its distinct pairs of ids, gets their
counts back and adds them up for its documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import pack_numbers, unpack_numbers
from weftline.llm.library_tokens import SpanCache, batch_ids, library_tokenizer
from weftline.llm.pretokens import pretokens
from weftline.llm.spill import splittable, stored
from weftline.llm.textarrays import chunks, ranges, text_bytes

CHUNK = 1 << 20
#: Spans that a Python worker remembers for each tokenizer.
CACHE = 1 << 19
#: Words after which a text is cut into another lane.
LANE_WORDS = 48
_SHIFT = 32
_HOLDER = "▁"
#: A character that is in no piece: pieces never join across it.
_GUARD = "\n"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """A vocabulary: the bytes of each id, their number, and the id as decimal digits with a place for a mark after them."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        digits = [b"%d," % i for i in range(len(tokens))]
        self.digit_lengths = np.array([len(x) for x in digits], np.int64)
        self.digits = np.frombuffer(b"".join(x.ljust(12) for x in digits), np.uint8)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _with_check(known: Tokens, spans: list[bytes], found: list[list[int]]) -> list[list[int]]:
    """Ids of each span after a 1 or 0: whether they stand for just its bytes."""
    return [[int(known.joined(ids) == span), *ids] for span, ids in zip(spans, found)]


class ByteLevel:
    """Tokenizer A: byte-level BPE of the tokenizers library; it joins nothing across pre-tokens."""

    def __init__(self, path: str):
        tokenizer = library_tokenizer(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        as_byte = byte_level()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        self.known = Tokens(tokens)
        self.cache = SpanCache(lambda spans: _with_check(self.known, spans, batch_ids(tokenizer, spans)), CACHE)

    spans = staticmethod(pretokens)


class Pieces:
    """Tokenizer B: BPE of sentencepiece with byte fallback; it joins nothing across two characters that no piece has side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(_HOLDER, " ").encode() for i, x in enumerate(names)]
        self.known = Tokens(tokens)
        plain = [x.replace(_HOLDER, " ") for i, x in enumerate(names) if not self.model.is_byte(i) and not self.model.is_control(i)]
        if any(_GUARD in x for x in plain):
            raise ValueError("a piece holds the character that keeps parts of texts apart")
        self.joins = np.zeros((128, 128), bool)
        #: Whether a space ever follows another character in a piece.
        self.space_joins = False
        for a, b in {pair for x in plain for pair in zip(x, x[1:])}:
            self.space_joins |= b == " " and a != " "
            if a < "\x80" and b < "\x80":
                self.joins[ord(a), ord(b)] = True
        self.guard = self.model.encode(_GUARD)
        self.cache = SpanCache(self._encoded, CACHE)

    def _encoded(self, spans: list[bytes]) -> list[list[int]]:
        # The model puts a space before a text; the guard takes it, so that a span is encoded as it stands.
        found = self.model.encode([_GUARD + x.decode() for x in spans], num_threads=1)
        return _with_check(self.known, spans, [ids[len(self.guard) :] for ids in found])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts that are encoded by themselves: cut where no piece joins two ASCII characters, and before a space after anything else."""
        cut = np.zeros(len(data) + 1, bool)
        a, b = data[:-1], data[1:]
        both = (a < 128) & (b < 128)
        cut[1:-1] = both & ~self.joins[a & 127, b & 127]
        if not self.space_joins:
            cut[1:-1] |= (b == 32) & (a != 32)
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], offsets)


@functools.cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of overlapping tokens in order, and whether each is the last of its group.

    ``ends_a`` and ``ends_b`` are the ends of all tokens in bytes; ``lanes_a`` and ``lanes_b`` the bounds of the lanes in tokens.
    Lanes begin and end at common ends.
    """
    i, j = lanes_a[:-1], lanes_b[:-1]
    stop_a, stop_b = lanes_a[1:], lanes_b[1:]
    found_a, found_b, closes = [], [], []
    width = np.ones(len(i), np.int64)
    keep = i < stop_a
    while True:
        i, j, stop_a, stop_b, width = (x[keep] for x in (i, j, stop_a, stop_b, width))
        if not len(i):
            break
        # A window of each lane is compared at its shift; what is equal from its start on is one-to-one.
        n = np.minimum(width, np.minimum(stop_a - i, stop_b - j))
        lane, place = ranges(n)
        a, b = i[lane] + place, j[lane] + place
        differs = np.where(ends_a[a] == ends_b[b], n[lane], place)
        run = np.minimum.reduceat(differs, np.cumsum(n) - n)
        one = place < run[lane]
        found_a.append(a[one])
        found_b.append(b[one])
        closes.append(np.ones(int(one.sum()), bool))
        i, j = i + run, j + run
        whole = run == n
        width = np.where(whole, 2 * width, 1)
        # Where the window breaks off, a group is walked to its next common end.
        at = np.flatnonzero(~whole)
        x, y = i[at], j[at]
        while len(at):
            end_a, end_b = ends_a[x], ends_b[y]
            found_a.append(x)
            found_b.append(y)
            closes.append(end_a == end_b)
            x, y = x + (end_a <= end_b), y + (end_b <= end_a)
            closed = end_a == end_b
            i[at[closed]], j[at[closed]] = x[closed], y[closed]
            at, x, y = at[~closed], x[~closed], y[~closed]
        keep = i < stop_a
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, closed = (np.concatenate(x) for x in (found_a, found_b, closes))
    # Every link comes at a greater sum of its indices than the one before.
    order = np.full(len(ends_a) + len(ends_b), -1, np.int64)
    order[a + b] = np.arange(len(a))
    order = order[order >= 0]
    return a[order], b[order], closed[order]


def written(a: Tokens, b: Tokens, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as text, ``a1,a2|b1;`` each, and where the text of each token of B ends.

    ``ends_a`` and ``ends_b`` are the ends of the groups in tokens.
    """
    group_a, group_b = np.repeat(np.arange(len(ends_a)), np.diff(ends_a, prepend=0)), np.repeat(np.arange(len(ends_b)), np.diff(ends_b, prepend=0))
    # The tokens of A of a group come before those of B.
    place_a = np.arange(len(ids_a)) + np.append(0, ends_b)[group_a]
    place_b = np.arange(len(ids_b)) + ends_a[group_b]
    n = len(ids_a) + len(ids_b)
    sizes, origin, mark = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    sizes[place_a], sizes[place_b] = a.digit_lengths[ids_a], b.digit_lengths[ids_b]
    origin[place_a], origin[place_b] = 12 * ids_a.astype(np.int64), len(a.digits) + 12 * ids_b.astype(np.int64)
    mark[place_a[ends_a - 1]] = ord("|")
    mark[place_b[ends_b - 1]] = ord(";")
    token, place = ranges(sizes)
    text = np.concatenate([a.digits, b.digits])[origin[token] + place]
    stops = np.cumsum(sizes)
    text[stops - 1] = mark
    return text.tobytes(), stops[place_b]


def aligned_chunk(tokenizer_a: ByteLevel, tokenizer_b: Pieces, column: pa.Array, lane_words: int = LANE_WORDS) -> dict[str, np.ndarray | list[str]]:
    """Alignment of the texts of a chunk: numbers by text, and the links as pairs of ids with their text."""
    column = column.cast(pa.large_string())
    some = pc.greater(pc.binary_length(column), 0).fill_null(False).to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    texts = len(some)
    sides = []
    for tokenizer in (tokenizer_a, tokenizer_b):
        starts, ends, first = tokenizer.spans(data, offsets)
        flat, bounds = tokenizer.cache.ids(data, starts, ends)
        head = bounds[:-1]
        wrong = np.zeros(texts, bool)
        text_of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        wrong[text_of[flat[head] == 0]] = True
        sides.append((starts, text_of, flat, head, np.diff(bounds) - 1, wrong))
    good = some & ~sides[0][-1] & ~sides[1][-1]

    ids, stops, texts_of, begins = [], [], [], []
    for tokenizer, (starts, text_of, flat, head, n, _) in zip((tokenizer_a, tokenizer_b), sides):
        kept = good[text_of]
        starts, text_of, head, n = starts[kept], text_of[kept], head[kept], n[kept]
        span, place = ranges(n)
        own = flat[head[span] + 1 + place].astype(np.int64)
        ids.append(own)
        stops.append(np.cumsum(tokenizer.known.lengths[own]))
        texts_of.append(text_of[span])
        begins.append((starts, text_of, np.cumsum(n) - n))
    # Lanes begin at texts and at every so many places where a span begins in both.
    shared, at_a, at_b = np.intersect1d(begins[0][0], begins[1][0], assume_unique=True, return_indices=True)
    text = begins[0][1][at_a]
    chosen = np.flatnonzero((np.arange(len(shared)) % lane_words == 0) | np.append(True, text[1:] != text[:-1])[: len(shared)])
    lanes_a = np.append(begins[0][2][at_a[chosen]], len(ids[0]))
    lanes_b = np.append(begins[1][2][at_b[chosen]], len(ids[1]))
    a, b, closes = links(*stops, lanes_a, lanes_b)

    link_text = texts_of[0][a]
    ends_a, ends_b = a[closes] + 1, b[closes] + 1
    raw, ends = written(tokenizer_a.known, tokenizer_b.known, *ids, ends_a, ends_b)
    last = np.searchsorted(texts_of[1], np.arange(texts), "right")
    first_byte, digests = 0, []
    for k in range(texts):
        if not good[k]:
            digests.append("")
            continue
        stop = int(ends[last[k] - 1])
        digests.append(hashlib.sha256(raw[first_byte : stop - 1]).hexdigest())
        first_byte = stop
    count = lambda values: np.bincount(values, minlength=texts)
    return {
        "n_a": count(texts_of[0]),
        "n_b": count(texts_of[1]),
        "n_groups": count(link_text[closes]),
        "n_links": count(link_text),
        "groups_sha256": digests,
        "pair": ids[0][a] << _SHIFT | ids[1][b],
        "text": link_text,
    }


CHUNKS = (
    "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, pair array<bigint>, n array<int>, held binary"
)
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk_rows(path_a: str, path_b: str, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", size):
                x = aligned_chunk(a, b, part.column("text"))
                pair, which, n = np.unique(x["pair"], return_inverse=True, return_counts=True)
                # The pairs of each text, and how often: places in ``pair``, as steps from the one before.
                held, times = np.unique(x["text"] * max(len(pair), 1) + which, return_counts=True)
                text, place = np.divmod(held, max(len(pair), 1))
                steps = np.where(np.append(True, text[1:] != text[:-1])[: len(text)], place, np.diff(place, prepend=0))
                one = lambda value, kind: pa.array([value], kind)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        one(chunk, pa.int64()),
                        one(part.column("doc_id").to_pylist(), longs),
                        *(one(x[name], longs) for name in _NUMBERS),
                        one(x["groups_sha256"], pa.list_(pa.string())),
                        one(pair, longs),
                        one(n.astype(np.int32), pa.list_(pa.int32())),
                        one(pack_numbers(np.bincount(text, minlength=part.num_rows), steps, times), pa.binary()),
                    ],
                    ["chunk", "doc_id", *_NUMBERS, "groups_sha256", "pair", "n", "held"],
                )
                chunk += 1

    return rows


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk, with the counts of their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            pair = row["pair"].values.to_numpy()
            total, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            if row["found"].is_valid:
                found = row["found"].values
                at = np.searchsorted(pair, found.field("pair").to_numpy())
                total[at] = found.field("total").to_numpy()
                best[at] = found.field("best").to_numpy()
            of, steps, times = (x.astype(np.int64) for x in unpack_numbers(row["held"].as_py()))
            bounds = np.append(0, np.cumsum(of))
            run = np.cumsum(steps)
            # Steps add up from the first place of each text.
            before = np.append(0, run)[bounds[:-1]]
            place = run - np.repeat(before, of)
            sums = [np.append(0, np.cumsum(times * values[place]))[bounds] for values in (best, total)]
            yield pa.RecordBatch.from_arrays(
                [
                    row["doc_id"].values,
                    *(row[name].values for name in _NUMBERS),
                    *(pa.array(np.diff(x)) for x in sums),
                    row["groups_sha256"].values,
                ],
                ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"],
            )


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def token_pairs(chunked: DataFrame) -> DataFrame:
    """How often each two ids are linked, and whether no id of A is linked to that of B more often: (pair, total, best)."""
    each = chunked.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(splittable(most, "b"), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Alignment of the tokens of each text by a byte-level BPE (A) and a sentencepiece BPE (B).

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``. The text is a space
    and the text of the row. Common ends of both cut the tokens into groups; every two tokens that overlap are a link. The count
    of a link is that of its two ids over all rows; ``n_best`` counts links with the highest count of their id of B, ties
    included, and ``count_sum`` adds all counts up. Texts that are null or empty, or whose tokens stand for other bytes, have
    no tokens and an empty digest. Rows that repeat a doc_id, and those with none, count like any other; other columns are ignored.
    ``path_a`` and ``path_b`` name files that every executor has.
    """
    chunked = stored(docs.select("doc_id", "text").mapInArrow(_chunk_rows(path_a, path_b, chunk), CHUNKS))
    asked = chunked.select("chunk", F.explode("pair").alias("pair"))
    answered = asked.join(splittable(token_pairs(chunked), "pair"), "pair")
    # A chunk gets at most as many rows back as it sent.
    found = answered.groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", "best")).alias("found"))
    return chunked.drop("n").join(found, "chunk", "left").drop("chunk").mapInArrow(_sum_rows, ALIGNED)
