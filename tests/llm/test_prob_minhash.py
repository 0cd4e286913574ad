"""Near-duplicate classes against comparing every pair."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest

from weftline.llm import prob_minhash
from weftline.llm.components import connected_components, merged_components
from weftline.llm.prob_minhash import near_duplicates, probability_jaccard, signatures
from weftline.llm.spill import shared_folder


def brute_similarity(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def weighted(text, size=5):
    words = text.split()
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_classes(docs, threshold):
    sets = {i: weighted(t or "") for i, t in docs}
    words = {i: (t or "").split() for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in docs:
        for j, _ in docs:
            same = words[i] == words[j] and words[i]
            if i < j and (same or brute_similarity(sets[i], sets[j]) >= threshold - 1e-9):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in docs}


@pytest.mark.parametrize("seed", range(20))
def test_probability_jaccard(seed):
    rng = np.random.default_rng(seed)
    a, b = (dict(zip(rng.choice(12, 7, False).tolist(), rng.integers(1, 5, 7).tolist())) for _ in range(2))
    pack = lambda x: (np.array(sorted(x)), np.array([x[i] for i in sorted(x)]))
    assert probability_jaccard(pack(a), pack(b)) == pytest.approx(brute_similarity(a, b))


def test_components_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    a = {int(x): int(w) for x, w in zip(range(60), rng.integers(1, 6, 60))}
    b = {int(x): int(w) for x, w in zip(range(15, 75), rng.integers(1, 6, 60))}
    text = np.repeat([0, 1], 60)
    shingle = np.array(sorted(a) + sorted(b), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight = np.array([a[i] for i in sorted(a)] + [b[i] for i in sorted(b)])
    found = signatures(text, shingle, weight, 2, 20_000)
    assert (found[0] == found[1]).mean() == pytest.approx(brute_similarity(a, b), abs=0.015)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    docs, bases = [], [[rng.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    for i in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "a " * 400), (206, "a " * 300)]
    return docs


@pytest.mark.parametrize("seed, block", [(0, 256), (1, 7)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(prob_minhash, "BLOCK", block)
    monkeypatch.setattr(prob_minhash, "TURNS", 1 if block == 7 else 2)
    docs = corpus(random.Random(seed))
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id bigint, text string, bucket string, class_id int")
    rows = near_duplicates(frame, bands=60).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs, 0.8)


def test_registered_bands_match_all_pairs(spark):
    """At the bands of the query, a pair at the threshold is missed once in 20,000 times."""
    docs = corpus(random.Random(7))
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs, 0.8)


def test_weighted_copies_across_blocks(spark, monkeypatch):
    """Without any turn, the blocks alone must find all components; sums over shares must not lose weighted texts."""
    monkeypatch.setattr(prob_minhash, "BLOCK", 5)
    monkeypatch.setattr(prob_minhash, "TURNS", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(base * 2 + [f"x{i}y{k}" for k in range(rng.randint(0, 14))] + base[: rng.randint(0, 30)])) for i in range(50)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), bands=60).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs, 0.8)


def test_empty_null_and_repeated_ids(spark):
    schema = "doc_id bigint, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(map(str, range(30)))
    rows = near_duplicates(spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (4, None)], schema)).collect()
    assert sorted(((r.doc_id or -1), r.class_id) for r in rows) == [(-1, None), (3, 3), (4, 4), (5, 3)]


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    rows = connected_components(links).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 103)}}


def test_rounds_leave_no_table_and_no_growing_estimate(spark):
    folder = Path(urlsplit(shared_folder(spark)).path)
    before = set(folder.glob("table-*"))
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    found = connected_components(links)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, 201)]
    assert set(folder.glob("table-*")) == before


def test_links_merge_known_components(spark):
    rng = random.Random(4)
    schema = "a bigint, b bigint"
    first, more = ([(rng.randrange(90), rng.randrange(90)) for _ in range(30)] for _ in range(2))
    merged = merged_components(connected_components(spark.createDataFrame(first, schema)), spark.createDataFrame(more, schema))
    whole = connected_components(spark.createDataFrame(first + more, schema))
    rows = {r.node: r.component for r in merged.collect()}
    assert rows == {r.node: r.component for r in whole.collect()}
    assert all(rows[a] == rows[b] for a, b in first + more if a != b)
    assert merged.count() == len(rows)
    none = spark.createDataFrame([], schema)
    assert merged_components(connected_components(none), none).collect() == []
