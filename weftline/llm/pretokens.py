"""Splitting texts into pre-tokens with numpy, as the pattern of the public byte-level BPE does.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches
follow from each character's class and its neighbours: a run of one class is a match, a space
joins the run after it, and the last of several white-space characters before a run stands apart.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    points = "".join(map(chr, range(0x110000)))
    found = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for match in regex.finditer(pattern, points):
            found[match.start() : match.end()] = kind
    return found


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    for low, high, more in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF7, 3)):
        rows = np.flatnonzero((lead >= low) & (lead <= high))
        value = points[rows] & (0x3F >> more)
        for i in range(more):
            value = value << 6 | (data[at[rows] + i + 1] & 0x3F)
        points[rows] = value
    return points, at


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each pre-token, and the index of the first one of each text (one more at the end)."""
    points, at = code_points(data)
    n = len(points)
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(at, offsets)] = True  # the first character of each text, and the end
    before = np.append(np.uint8(OTHER), kind[:-1])
    # A space right before a run of another class belongs to the run.
    joined = (kind != SPACE) & (np.append(0, points[:-1]) == 32) & ~opens[:-1]
    start = opens[:-1] | ((kind != before) & ~joined)
    ends_white = (kind == SPACE) & ~opens[1:]
    ends_white[:-1] &= kind[1:] != SPACE
    start |= ends_white
    short = np.flatnonzero((points == 39) & start)
    if len(short):
        padded = np.append(points, [0, 0])
        # Characters beyond the text's end are no part of a contraction.
        inside = np.append(~opens[1:], [False, False])
        second, third = padded[short + 1], padded[np.minimum(short + 2, n + 1)]
        has_second = inside[short]
        has_third = has_second & inside[np.minimum(short + 1, n + 1)]
        length = np.where(has_second & np.isin(second, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            length[has_third & (second == ord(pair[0])) & (third == ord(pair[1]))] = 2
        short, length = short[length > 0], length[length > 0]
        start[short + 1] = False
        start[short[length == 2] + 2] = False
        after = short + 1 + length
        start[after[after < n]] = True
    at = np.append(at, len(data))
    starts = at[:-1][start]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)
