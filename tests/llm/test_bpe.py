"""BPE against the tiktoken library, and pre-tokens against the pattern itself."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.bpe import Vocabulary, decode, encode, encode_chunk, read_ranks
from weftline.llm.pretokens import pretokens
from weftline.llm.textarrays import text_bytes
from weftline.sources import read_table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXTS = st.lists(st.text(st.sampled_from("ab sSretvldm'12!  \n\t\r 　éß漢😀²"), max_size=30), max_size=6)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    ranks = {token: rank for rank, token in enumerate(read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_pretokens_are_the_matches_of_the_pattern(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = pretokens(data, offsets)
    raw = data.tobytes()
    found = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert found == [PATTERN.findall(text) for text in texts]


def test_perfect_hash(vocabulary):
    assert vocabulary.find(vocabulary.keys).tolist() == list(range(len(vocabulary.tokens)))
    assert (vocabulary.find(np.arange(1000, dtype=np.uint64)) == -1).all()


@settings(max_examples=200, deadline=None)
@given(TEXTS | st.lists(st.text(), max_size=4))
def test_ids_are_those_of_the_library(vocabulary, library, texts):
    ids, bounds = encode_chunk(vocabulary, {}, *text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(x) for x in texts]


def test_query_table(spark, library):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "xyzzy" * 600), (-4, "<|endoftext|> it's  \n")], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = decode(encode(docs, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (bytes(r.ids), r.n_tokens) == (ids.tobytes(), len(ids))
        assert hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256(texts[r.doc_id].encode()).digest()


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id bigint, text string, ids int"), PATH), PATH).collect() == []
