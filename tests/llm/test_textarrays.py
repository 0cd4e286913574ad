"""Hashes and distinct spans, on words that a sum of powers can't tell apart."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import textarrays
from weftline.llm.best_fit import token_ids
from weftline.llm.bpe import encode_chunk, read_ranks, vocabulary
from weftline.llm.line_quality import line_quality
from weftline.llm.prob_minhash import near_duplicates
from weftline.llm.run_length_index import remove_repeats
from weftline.llm.textarrays import byte_hashes, distinct_spans, equal_spans, text_bytes, words


def twins(size):
    """A word of a and b and the one with its letters swapped, by the parity of the ones of each place (Thue and Morse)."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def spans(texts):
    data, offsets = text_bytes(pa.array(texts))
    return data, offsets[:-1], offsets[1:]


def test_distinct_spans_compare_bytes(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 20, 600]))) for _ in range(3000)] + [*twins(2048)] * 2
    for weak in (False, True):
        if weak:  # hashes that collide all the time
            monkeypatch.setattr(textarrays, "byte_hashes", lambda d, a, b: byte_hashes(d, a, b) % np.uint64(3))
        data, a, b = spans(texts)
        at, _, which = distinct_spans(data, a, b)
        assert len(at) == len(set(texts))
        assert [texts[i] for i in at[which].tolist()] == texts


def test_equal_spans():
    data, a, b = spans(["abcdefgh1", "abcdefgh2", "abcdefgh1", "x" * 700, "x" * 699 + "y", ""])
    pairs = [(0, 1, False), (0, 2, True), (3, 4, False), (3, 3, True), (5, 5, True)]
    i, j = (np.array(x) for x in list(zip(*pairs))[:2])
    assert equal_spans(data, a[i], a[j], (b - a)[i]).tolist() == [x for _, _, x in pairs]


def test_hashes_of_twins_differ():
    for size in (8, 64, 512, 1024, 2048, 4096):
        data, a, b = spans([*twins(size)])
        assert len(set(byte_hashes(data, a, b).tolist())) == 2


def test_ids_of_twins():
    one, other = twins(1024)
    texts = [one, other, f"{other} {one}", "a b"]
    data, offsets = text_bytes(pa.array(texts))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids, bounds = encode_chunk(vocabulary(path), {}, data, offsets)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(path))}, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode_ordinary(x) for x in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, bounds = token_ids(path, data, offsets)
    tokenizer = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_operators_tell_twins_apart(spark):
    one, other = twins(1024)
    rows = [(1, " ".join([one] * 30)), (2, " ".join([other] * 30)), (3, "\n".join([one, other] * 12)), (4, "\n".join([one, one] * 12))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {i: i for i in (1, 2, 3, 4)} | {4: 1}
    found = {r.doc_id: r.n_dup_lines for r in line_quality(docs).select("row.doc_id", "quality.n_dup_lines").collect()}
    assert found == {1: 0, 2: 0, 3: 22, 4: 23}
    # The 200-byte strings of a twin and of its other: what both hold goes, the rest stays.
    pair = spark.createDataFrame([(1, one[:256]), (2, other[:256])], "doc_id bigint, text string")
    kept = {r.doc_id: r.sha for r in remove_repeats(pair).select("doc_id", F.sha2("kept", 256).alias("sha")).collect()}
    assert kept == {i: hashlib.sha256(x[:256].encode()).hexdigest() for i, x in ((1, one), (2, other))}


def test_words_of_long_texts():
    data, offsets = text_bytes(pa.array(["a bb " * 200_000, None, " x"]))
    starts, ends, first = words(data, offsets)
    assert first.tolist() == [0, 400_000, 400_000, 400_001] and set((ends - starts).tolist()) == {1, 2}
