"""Sketches against plain sets, and edited texts against plain strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm.iblt import ATTEMPTS, _peeled, _signed, _sketch, decoded, digest_likeness, edited_pairs, encoded, fingerprints, likeness, paragraph_digests, sketch


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_likeness_is_exact(spark):
    rng = random.Random(0)
    rows = []
    for i in range(150):
        pool = [rng.getrandbits(63) for _ in range(rng.choice([1, 5, 40, 300]))]
        rows.append((i, rng.sample(pool, rng.randint(0, len(pool))), rng.sample(pool, rng.randint(0, len(pool)))))
    rows += [(1000, [], []), (1001, [5], []), (1002, [0, -1], [0])]
    frame = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
    true = {k: pytest.approx(jaccard(a, b)) for k, a, b in rows}
    got = {r.k: r.near for r in frame.select("k", digest_likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert got == true
    # As stored: from two strings, after the digests are gone.
    kept = frame.select("k", encoded(sketch(F.col("a"))).alias("a"), encoded(sketch(F.col("b"))).alias("b"))
    got = {r.k: r.near for r in kept.select("k", likeness(decoded(F.col("a")), decoded(F.col("b"))).alias("near")).collect()}
    assert got == true


def test_a_fingerprint_gives_its_digests_back(spark):
    rng = random.Random(3)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for i, n in enumerate([0, 1, 2, 4, 5, 8, 9, 100, 2000])]
    frame = spark.createDataFrame(rows, "k int, a array<bigint>")
    text = {r.k: r.t for r in frame.select("k", encoded(sketch(F.col("a"))).alias("t")).collect()}
    for k, digests in rows:
        blocks = text[k].split(";")
        assert len(blocks) & (len(blocks) - 1) == 0 and len(blocks) * 4 >= len(digests)
        alone = {c.split(":")[1] for b in blocks for c in b.split(".") if c.startswith("1:")}
        assert {int(x, 16) for x in alone} == {d % 2**64 for d in digests}


def test_stored_fingerprints_are_what_is_compared(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, "\n".join(f"line {rng.randint(0, 30)}." for _ in range(rng.choice([0, 1, 6, 30, 31, 150])))) for i in range(60)]
    fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    after = {i: docs[(k + 1) % len(docs)][0] for k, (i, _) in enumerate(docs)}
    links = spark.createDataFrame(list(after.items()), "doc_id bigint, next_id bigint")
    other = rows.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    again = rows.join(links, "doc_id").join(other, "next_id").select(
        "near_edited",
        "near_next",
        likeness(decoded(F.col("fingerprint")), decoded(F.col("edited_fingerprint"))).alias("edited_again"),
        likeness(decoded(F.col("fingerprint")), decoded(F.col("next_fingerprint"))).alias("next_again"),
    ).collect()
    assert len(again) == 60 and all(r.near_edited == r.edited_again and r.near_next == r.next_again for r in again)
    assert any(0 < r.near_edited < 1 for r in again) and any(0 < r.near_next < 1 for r in again)


def test_peeling_fails_when_too_small_and_recovers_when_larger(spark):
    rng = random.Random(1)
    rows = [(i, [rng.getrandbits(63) for _ in range(14)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "k int, a array<bigint>")
    got = frame.select(*[_peeled(_sketch(_signed(F.col("a"), 1), F.lit(s))).alias(f"s{s}") for s in ATTEMPTS]).collect()
    assert all(r.s3 is None for r in got) and sum(r.s48 is not None for r in got) >= 38
    assert all(x is None or tuple(x) == (14, 0) for r in got for x in r)


def plain(docs):
    docs = sorted((i, t or "") for i, t in docs)
    out = {}
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        out[i] = text[: len(text) - half] + after[:half]
    return out


def test_edited_texts_and_fingerprints(spark):
    rng = random.Random(2)
    docs = [(rng.randint(-(10**12), 10**12), "\n".join("".join(rng.choice("ab é漢. ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    docs += [(5, None), (6, ""), (7, "x. " * 30_000), (8, docs[0][1]), (9, "no newline " * 40)]
    frame = spark.createDataFrame([(i, t, "f", 0.5) for i, t in docs], "doc_id bigint, text string, fingerprint string, near_next double")
    digests = lambda values: {r[0]: r[1] for r in spark.createDataFrame(list(values.items()), "k bigint, t string").select("k", paragraph_digests(F.col("t"))).collect()}
    edited, own = plain(docs), {i: t or "" for i, t in docs}
    d_own, d_edited, order = digests(own), digests(edited), sorted(own)
    rows = {r.doc_id: r for r in fingerprints(frame).collect()}
    assert len(rows) == len(docs)
    for k, i in enumerate(order):
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(d_own[i], d_edited[i]))
        assert r.near_next == pytest.approx(jaccard(d_own[i], d_own[order[(k + 1) % len(order)]]))
    assert rows[8].fingerprint == rows[docs[0][0]].fingerprint
    assert len({r.fingerprint for r in rows.values()}) == len(set(own.values()))


def test_empty_null_and_repeated_ids(spark):
    schema = "doc_id bigint, text string"
    assert fingerprints(spark.createDataFrame([], schema)).collect() == []
    rows = edited_pairs(spark.createDataFrame([(1, "abcd"), (2, "zz"), (2, "yy"), (2, "yy"), (None, "pqrs")], schema)).collect()
    found = sorted((r.doc_id or 0, r.edited_sha256) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == sorted([(1, sha("abyy")), (2, sha("za")), (2, sha("ya")), (2, sha("ya")), (0, sha("pq"))])


def test_one_document_is_next_to_itself(spark):
    (row,) = fingerprints(spark.createDataFrame([(3, "abc\ndef")], "doc_id bigint, text string")).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abc\nabc").hexdigest()
