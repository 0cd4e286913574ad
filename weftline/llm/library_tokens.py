"""Ids of many short spans by a tokenizer library, each distinct span encoded once.

A tokenizer that never joins bytes across certain places, such as before a pre-token, gives the ids of a text span by span.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from weftline.llm.textarrays import distinct_spans, ranges

#: Bytes of text whose spans are looked up together.
CHUNK = 2 << 20
#: Spans whose ids a Python worker remembers, and the most bytes of such a span; when full, it starts again.
CACHE, CACHED_BYTES = 1 << 19, 64


def library_tokenizer(path: str):
    """A tokenizer of the tokenizers library that works in the calling thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def batch_ids(tokenizer, spans: list[bytes]) -> list[list[int]]:
    return [x.ids for x in tokenizer.encode_batch_fast([x.decode() for x in spans], add_special_tokens=False)]


def joined_ids(tokenizer, spans: list[bytes], together: int = 512) -> list[list[int]]:
    """As ``batch_ids`` for a tokenizer that drops spaces and joins nothing across them: many spans are encoded as one text."""
    texts = [x.decode() for x in spans]
    groups = [texts[i : i + together] for i in range(0, len(texts), together)]
    found: list[list[int]] = []
    for group, encoding in zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
        starts = np.cumsum([0, *(len(x) + 1 for x in group)])
        at = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.ids))
        cuts, ids = np.searchsorted(at, starts).tolist(), encoding.ids
        found += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    return found


class SpanCache:
    """Ids of spans by ``encode``, a function of a list of spans, remembered from batch to batch."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = CACHE):
        self.encode, self.most = encode, most
        self.known: dict[bytes, tuple[int, ...]] = {}

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans back to back, and the bounds of each span's."""
        at, _, which = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.known) + len(distinct) > self.most:
            self.known.clear()
        lists = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(lists) if ids is None]
        for i, ids in zip(missing, self.encode([distinct[i] for i in missing]) if missing else ()):
            lists[i] = ids = tuple(ids)
            if len(distinct[i]) <= CACHED_BYTES:
                self.known[distinct[i]] = ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        token, place = ranges(sizes[which])
        return flat[begin[which][token] + place], np.append(0, np.cumsum(sizes[which]))
