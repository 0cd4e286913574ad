"""Aligned tokens against the plain calls of both libraries and a walk token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.queries import op13_token_alignment
from weftline.llm.token_alignment import align_tokens, aligned_chunk, byte_level, links, tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names, level = {i: t for t, i in a.get_vocab().items()}, byte_level()

    def tokens(text):
        """Ids and bytes of both, or none."""
        if not text:
            return [], []
        found = [(i, bytes(level[c] for c in names[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        other = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            other.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = f" {text}".encode()
        return (found, other) if b"".join(x for _, x in found) == whole == b"".join(x for _, x in other) else ([], [])

    return tokens


def ends(tokens):
    return np.cumsum([len(x) for _, x in tokens]).tolist()


def walk(a, b):
    """Links as pairs of places, and groups as text."""
    ends_a, ends_b = ends(a), ends(b)
    found, groups, own_a, own_b, i, j = [], [], [], [], 0, 0
    while i < len(a):
        found.append((i, j))
        own_a, own_b = own_a + [a[i][0]] * (not own_a or own_a[-1] != (i,)), own_b
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append((i, j))
    texts, p, q = [], 0, 0
    for i, j in groups:
        texts.append(",".join(str(x) for x, _ in a[p:i]) + "|" + ",".join(str(x) for x, _ in b[q:j]))
        p, q = i, j
    return found, ";".join(texts), len(groups)


def brute(rows, tokens):
    counts, by_row = Counter(), []
    for _, text in rows:
        a, b = tokens(text)
        found, groups, n = walk(a, b)
        pairs = [(a[i][0], b[j][0]) for i, j in found]
        # Overlaps by their definition, without the walk.
        spans = [[(e - len(x), e) for e, (_, x) in zip(ends(t), t)] for t in (a, b)]
        if len(a) < 60:
            assert found == [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if max(p, r) < min(q, s)]
        counts.update(pairs)
        by_row.append((len(a), len(b), n, pairs, groups))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (doc, n_a, n_b, n, len(pairs), sum(counts[x] == best[x[1]] for x in pairs), sum(counts[x] for x in pairs), hashlib.sha256(groups.encode()).hexdigest() if pairs else "")
        for (doc, _), (n_a, n_b, n, pairs, groups) in zip(rows, by_row)
    ]


ODD = [
    "Hello  world\n x <s> it's 1,234.50!",
    "<|endoftext|> <unk></s> [INST]",
    "  leading and trailing  ",
    " ",
    "\n",
    "a \n\n  b\t\tc\r\n",
    "日本語。 です、हिन्दी। ok",
    "👩‍👩‍👧 é  x　y",
    "a▁b",
    "\x00 \x7f\x85",
    "x" * 2000,
    "thering tiontion unbelievablyantidisestablishmentarian http://a.b/c?d=e&f#g",
]


def check_chunk(texts, tokens, lane_words):
    found = aligned_chunk(*tokenizers(A, B), pa.array(texts, pa.string()), lane_words)
    for k, text in enumerate(texts):
        a, b = tokens(text)
        pairs, groups, n = walk(a, b)
        assert (found["n_a"][k], found["n_b"][k], found["n_groups"][k], found["n_links"][k]) == (len(a), len(b), n, len(pairs)), repr(text)
        assert found["groups_sha256"][k] == (hashlib.sha256(groups.encode()).hexdigest() if pairs else "")
        assert found["pair"][found["text"] == k].tolist() == [a[i][0] << 32 | b[j][0] for i, j in pairs]


@pytest.mark.parametrize("lane_words", [1, 2, 1000])
def test_odd_texts(plain, lane_words):
    check_chunk([*ODD, None, "", *ODD[:3]], plain, lane_words)
    check_chunk([None, ""], plain, lane_words)
    check_chunk([], plain, lane_words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab SE'1.,\n\t é<|_-", max_size=40), max_size=4), st.sampled_from([1, 3, 50]))
def test_any_texts(plain, texts, lane_words):
    check_chunk(texts, plain, lane_words)


@pytest.mark.parametrize("seed", range(5))
def test_links_of_random_ends(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        size = int(rng.integers(1, 400))
        both = np.flatnonzero(rng.random(size) < rng.choice([0.02, 0.5])) + 1
        cuts = [np.union1d(np.union1d(both, [size]), np.flatnonzero(rng.random(size) < rng.choice([0.0, 0.3, 0.9])) + 1) for _ in range(2)]
        shared = np.intersect1d(*cuts)
        lanes = np.append(0, np.sort(rng.choice(shared[:-1], min(3, len(shared) - 1), replace=False))) if len(shared) > 1 else np.array([0])
        bounds = [np.append(np.searchsorted(x, lanes, "right"), len(x)) for x in cuts]
        a, b, closes = links(*cuts, *bounds)
        every = np.union1d(*cuts)
        assert a.tolist() == np.searchsorted(cuts[0], every).tolist() and b.tolist() == np.searchsorted(cuts[1], every).tolist()
        assert closes.tolist() == np.isin(every, shared).tolist()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r))


def test_table(spark, plain):
    rng = random.Random(5)
    words = "the river Stone un stones, thering 12 é it's".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for i in range(60)] + list(enumerate(ODD, 100))
    rows += [(None, "the river"), (7, "the same id"), (7, "the same id"), (900, None), (901, ""), (902, "river stone " * 30_000)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(5).selectExpr("*", "1 AS n_a", "'x' AS pair", "2 AS chunk")
    expected = sorted(brute(rows, plain), key=lambda r: (r[0] is None, r[0] or 0, r))
    assert rows_of(align_tokens(frame, A, B, chunk=3000)) == expected
    assert rows_of(align_tokens(frame, A, B)) == expected


def test_no_rows_and_no_tokens(spark):
    schema = "doc_id bigint, text string"
    assert align_tokens(spark.createDataFrame([], schema), A, B).collect() == []
    found = align_tokens(spark.createDataFrame([(1, None), (2, ""), (3, "a▁b")], schema), A, B).collect()
    assert sorted(map(tuple, found)) == [(1, *NONE), (2, *NONE), (3, *NONE)]


def test_query(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = op13_token_alignment(spark, sf_dir)
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert found.dtypes == [(n, "bigint") for n in names[:-1]] + [(names[-1], "string")]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, plain))
