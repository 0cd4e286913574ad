"""Repeated-string removal against a brute-force search."""

import random

import numpy as np
import pytest

from weftline.llm.run_length_index import longest_elsewhere, remove_repeats


def brute_longest(texts):
    whole = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
    best = {}
    for a in whole:
        best[a] = 0
        for b in whole:
            if a != b:
                x, y = texts[a[0]][a[1] :], texts[b[0]][b[1] :]
                n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
                best[a] = max(best[a], n)
    return [best[a] for a in whole]


@pytest.mark.parametrize("seed", range(25))
def test_longest_elsewhere(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab" if seed % 3 else b"a") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = np.ones(len(data), bool)
    keep[ends - 1] = False
    assert longest_elsewhere(data, ends)[keep].tolist() == brute_longest(texts)


def brute(docs, length):
    seen = {}
    for i, text in docs:
        text = (text or "").encode()
        for j in range(len(text) - length + 1):
            seen.setdefault(text[j : j + length], []).append((i, j))
    cover = {i: set() for i, _ in docs}
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                cover[i].update(range(j, j + length))
    return {i: bytes(b for k, b in enumerate((t or "").encode()) if k not in cover[i]) for i, t in docs}


def corpus(rng):
    passage = "".join(rng.choice("abcé ") for _ in range(90))
    docs = []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 120)))
        at = rng.randint(0, len(passage) - 1)
        docs.append((i, own[:50] + passage[: at if i % 3 else None] + own[50:]))
    docs += [(100, None), (101, ""), (102, "x" * 500), (103, docs[5][1]), (104, docs[5][1]), (105, "ab" * 90), (106, "ü" * 31)]
    return docs


@pytest.mark.parametrize("key_segments", [1000, 3])
def test_matches_brute_force(spark, key_segments):
    docs = corpus(random.Random(key_segments))
    frame = spark.createDataFrame([(i, t, "own", -1) for i, t in docs], "doc_id bigint, text string, spans string, key int")
    rows = remove_repeats(frame, length=20, seed=8, key_segments=key_segments).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == brute(docs, 20)
    for r in rows:
        assert r.n_bytes - sum(x["to"] - x["from"] for x in r.spans) == len(r.kept)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(empty).collect() == []
    rows = remove_repeats(spark.createDataFrame([(None, "y" * 300), (1, "z")], empty.schema)).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in rows) == [(0, 300), (1, 1)]
