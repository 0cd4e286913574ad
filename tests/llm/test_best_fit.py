"""Packing: legal places, piece contents against the library, and counts near or at the optimum."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm.best_fit import pack, packed, plan
from weftline.sources import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expand(counts, capacity):
    """The sequences of a plan, each its pieces by place; checks that they are gapless and fit."""
    sequences, seen = defaultdict(list), Counter()
    for length, first, until, sequence, each, offset in plan(counts, capacity):
        assert first == seen[length]
        seen[length] = until
        for i in range(until - first):
            sequences[sequence + i // each].append((offset + i % each * length, length))
    assert seen == Counter(counts)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def optimum(items, capacity):
    best = len(items)

    def search(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= rest[0]:
                search(rest[1:], bins[:i] + [bins[i] - rest[0]] + bins[i + 1 :])
        search(rest[1:], [*bins, capacity - rest[0]])

    search(sorted(items, reverse=True), [])
    return best


def test_near_the_optimum():
    excess = 0
    for seed in range(150):
        rng = random.Random(seed)
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        excess += len(expand(dict(Counter(items)), 20)) - optimum(items, 20)
    assert excess <= 3


def test_reduction_is_exact_where_at_most_two_fit():
    for seed in range(60):
        rng = random.Random(seed)
        items = [rng.randint(7, 20) for _ in range(rng.randint(1, 10))]
        assert len(expand(dict(Counter(items)), 20)) == optimum(items, 20)


def test_large_counts():
    rng = random.Random(1)
    counts = {w: rng.randint(0, 10**7) for w in range(1, 1025)}
    rows = plan(counts)
    used = max(s + -(-(u - f) // e) for _, f, u, s, e, _ in rows)
    assert len(rows) < 20_000 and used <= 1.02 * sum(w * n for w, n in counts.items()) / 1024


def check(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        at = 0
        for i, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and 1 <= r.length <= 1024 and (i == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence)


#: Texts that spell the added token: alone, inside, repeated, in part, and beyond one chunk.
ADDED = [
    (-4, "<|endoftext|>"),
    (-5, "a <|endoftext|> b\n<|endoftext|>"),
    (-6, "<|endoftext|>" * 3),
    (-7, "<|endoftext|"),
    (-8, "x<|endoftext|>y" + " word" * 9000),
]


def test_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "abc " * 3000), *ADDED, *[(-i, "same text") for i in range(10, 60)]]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string")).selectExpr("*", "1 AS length", "'x' AS offset")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packed(docs, PATH).collect()
    assert check(rows, texts) <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_empty_and_repeated(spark):
    schema = "doc_id bigint, text string"
    assert packed(spark.createDataFrame([], schema), PATH).collect() == []
    rows = packed(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], schema), PATH).collect()
    assert sorted(r.offset for r in rows) == [0, *sorted({r.offset for r in rows} - {0})] and len({r.sequence_id for r in rows}) == 1
