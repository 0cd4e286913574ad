"""Texts of an Arrow batch as one byte array, and hashes over spans of it.

Helpers for the operators whose work inside a Spark task is vectorised with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Numbers that are worked on at a time where each is needed several times.
_BLOCK = 1 << 14
#: Longer spans are hashed and compared one by one, shorter ones eight bytes of all of them at a time.
LONG_SPAN = 512


def _byte_codes() -> np.ndarray:
    """An odd-looking 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that close inputs give unrelated outputs (the splitmix64 finaliser)."""
    z = np.array(values, np.uint64, ndmin=1)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


BYTE_CODES = _byte_codes()
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``name`` column holds about ``limit`` bytes; one longer text is a slice of its own."""
    _, offsets = text_bytes(batch.column(name))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back, and the offset of each; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    values = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return values, offsets - first if len(column) else np.zeros(1, np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``codes[start:end]``; equal spans have equal hashes wherever they lie."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return mix(values ^ mix((ends - starts).astype(np.uint64)))


def rolling_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of every run of ``size`` bytes."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    values = sums[size:] - sums[:-size]
    values *= down[: len(values)]
    values ^= mix(np.array([size], np.uint64))
    return mix(values)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))


def _low_bytes(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values`` with all but their ``n`` low bytes cleared."""
    return values & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(n, 8).astype(np.uint64)))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes.

    Every eight bytes are scrambled together with what came before, so that no regular pattern cancels out, as it does in a
    sum of powers. Spans of up to eight bytes never collide with others of their length.
    """
    lengths = ends - starts
    state = mix(lengths.astype(np.uint64))
    eights, active, at = _eights(data), np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN)), 0
    while len(active):
        rest = lengths[active] - at
        state[active] = mix(state[active] ^ _low_bytes(eights[starts[active] + at], rest))
        at += 8
        active = active[rest > 8]
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return state


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of ``lengths`` bytes from ``a`` and from ``b`` on hold the same bytes."""
    same = np.ones(len(a), bool)
    eights, active, at = _eights(data), np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN)), 0
    while len(active):
        rest = lengths[active] - at
        equal = _low_bytes(eights[a[active] + at] ^ eights[b[active] + at], rest) == 0
        same[active[~equal]] = False
        at += 8
        active = active[equal & (rest > 8)]
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + lengths[i]], data[b[i] : b[i] + lengths[i]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans of bytes: one index and the hash of each distinct one, and the distinct one of each span.

    Spans of equal hashes are compared byte by byte, so different ones never count as one.
    """
    hashes, lengths = byte_hashes(data, starts, ends), ends - starts
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (lengths[order[1:]] != lengths[order[:-1]])
    alike = np.flatnonzero(~new)
    wrong = ~equal_spans(data, starts[order[alike - 1]], starts[order[alike]], lengths[order[alike]])
    which = np.empty(len(order), np.int64)
    if wrong.any():  # two different spans with one hash, which may lie in any order
        numbers: dict[bytes, int] = {}
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            which[i] = numbers.setdefault(data[a:b].tobytes(), len(numbers))
        at = np.unique(which, return_index=True)[1]
        return at, hashes[at], which
    which[order] = np.cumsum(new) - 1
    return order[new], ranked[new], which


def byte_runs(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each longest run of ``kept`` bytes within a text, and the index of the first run of each text (one more at the end)."""
    inside = np.concatenate([[False], kept, [False]])
    edge = np.zeros(len(kept) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``byte_runs`` of all bytes but 0x20 and 0x09 to 0x0D."""
    return byte_runs((data != 32) & ((data < 9) | (data > 13)), offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of the first word of each text (one more at the end)."""
    starts, ends, first = words(data, offsets)
    return byte_hashes(data, starts, ends), first


def ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run each element belongs to, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shingle_hashes(
    values: np.ndarray, first: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, the text it is from, and its first word's index.

    Each place in the run has a factor of its own; ``size`` is at most 64.
    """
    text, place = ranges(np.maximum(np.diff(first) - size + 1, 0))
    at = first[:-1][text] + place
    sums = np.zeros(max(len(values) - size + 1, 0), np.uint64)
    for low in range(0, len(sums), _BLOCK):  # numbers that stay in a core's cache
        part = sums[low : low + _BLOCK]
        for i, factor in enumerate(_FACTORS[:size]):
            part += values[low + i : low + i + len(part)] * factor
    return mix(sums[at]) if len(at) else sums[:0], text, at


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    if len(values) < size:
        return values[:0]
    minima, width = values, 1
    while 2 * width <= size:
        minima = np.minimum(minima[:-width], minima[width:])
        width *= 2
    rest = size - width
    return np.minimum(minima[: len(minima) - rest], minima[rest:]) if rest else minima
