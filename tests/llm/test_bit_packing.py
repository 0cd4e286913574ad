"""Packed ids against the library, and files against their parts."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.bit_packing import BLOCK, Reader, Writer, bits_for, pack_ids, read_ids, text_ids, unpack_ids, write_ids
from weftline.llm.queries import op11_bit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        raw = pack_ids(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert np.array_equal(unpack_ids(raw, bits, n), ids)


def test_widths():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError, match="more than 4 bits"):
        pack_ids(np.array([16]), 4)


@pytest.mark.parametrize("bits, block", [(5, 8), (16, BLOCK), (17, 16)])
def test_random_access(bits, block):
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in [0, 1, 3, 100, 0, 9000, 5]]
    file = io.BytesIO()
    writer = Writer(file, bits, block)
    for k, low in enumerate((0, 3)):  # added in two parts
        part = docs[low : low + (3 if k == 0 else 4)]
        writer.add(np.arange(low, low + len(part)), np.zeros(len(part), bool), np.array([len(x) for x in part]), np.concatenate(part))
    writer.finish()
    reader = Reader(file, len(file.getvalue()))
    for k, x in enumerate(docs):
        assert np.array_equal(reader.document(k), x)
    whole = np.concatenate(docs)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert np.array_equal(reader.ids(a, b), whole[a:b])
    with pytest.raises(IndexError):
        reader.ids(0, len(whole) + 1)


def test_reads_only_the_blocks_asked_for():
    file = io.BytesIO()
    writer = Writer(file, 16)
    writer.add(np.array([1]), np.array([False]), np.array([100 * BLOCK]), np.arange(100 * BLOCK) % 49408)
    writer.finish()
    reader, size = Reader(file, len(file.getvalue())), []
    reader.file = type("File", (), {"seek": lambda s, x: file.seek(x), "read": lambda s, n: size.append(n) or file.read(n)})()
    assert reader.ids(5 * BLOCK + 3, 5 * BLOCK + 6).tolist() == [(5 * BLOCK + i) % 49408 for i in (3, 4, 5)]
    assert size == [2 * BLOCK]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="no file of packed ids"):
        Reader(io.BytesIO(b"x" * 100), 100)


ODD = ["", " ", "Hello  World\u00a0it's\t1999", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "İstanbul ŞAŞ", "e\u0301 \u0301e n\u0303", "日本語。\u3000です", "x" * 3000, "👩‍👩‍👧 ok", "\x00\x1c\x85 a\u2028b"]
# Contractions in odd places, marks that compose with one case only, and digits.
ODD += ["IT'S 'Stone 'LL,'s x''s 'a'b' 's2 n't2't", "H\u0331h T\u0308t J\u030c, I\u0307i K\u0301", "12ab3,4.5%a-b_c//d", "A\u030a.B=\u0338c", "x<|EndOfText|>y<|endoftext|>z1<|endoftext|", "end'", "'"]


def test_ids_of_odd_texts():
    ids, sizes = text_ids(PATH, pa.array([*ODD, None]))
    cuts = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == plain([*ODD, None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("aBsStT'12,. \n\u0301\u0331é<|>", max_size=30), max_size=5))
def test_ids_of_any_texts(texts):
    ids, sizes = text_ids(PATH, pa.array(texts, pa.string()))
    cuts = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == plain(texts)


def expected(rows):
    at, found = 0, []
    for (doc, _), ids in zip(rows, plain([x for _, x in rows])):
        found.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_table_over_several_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Stone", "river,", "x1", "é"]) for _ in range(rng.randint(0, 400)))) for i in range(300)]
    rows += [(1000, None), (1001, "long " * 450_000), (1002, ""), (1003, "long " * 450_000), (1004, "end")]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id bigint, text string").selectExpr("*", "1 AS start", "'x' AS file", "0 AS _row")
    files = write_ids(docs, str(tmp_path), PATH, file_ids=2000)
    assert files.count() > 8
    found = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read_ids(files, str(tmp_path), 5000).collect()]
    assert sorted(found) == expected(sorted(rows))


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    schema = "doc_id bigint, text string"
    files = write_ids(spark.createDataFrame([], schema), f"{tmp_path}/none", PATH)
    assert read_ids(files, f"{tmp_path}/none").collect() == []
    rows = [(None, "b c"), (3, "same"), (3, "same"), (3, "other text"), (1, "a"), (None, None)]
    files = write_ids(spark.createDataFrame(rows, schema), f"{tmp_path}/some", PATH)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in read_ids(files, f"{tmp_path}/some").collect())
    assert [x[1] for x in found] == [None, None, 1, 3, 3, 3]
    assert [x[0] for x in found] == np.append(0, np.cumsum([x[2] for x in found]))[:-1].tolist()
    assert sorted(x[2] for x in found) == sorted(len(x) for x in plain([x for _, x in rows]))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = op11_bit_packing(spark, sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, found.collect())) == expected(rows)
