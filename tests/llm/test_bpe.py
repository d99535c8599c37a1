from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgate.llm.bpe import byte_bpe, decode, decode_ids, encode_texts, merge_word, read_ranks, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' tsdé1 \n\t\x0b\x1c\x85\xa0 .!😀漢0ñ"))))
def test_pieces_agree_with_the_library(library, text):
    encoder, pieces = byte_bpe(PATH, PATTERN)
    ids = encoder(text)
    assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)
    assert decode(ids, pieces) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab' tsdé1 \n\t\x0b\x1c\x85\xa0\u2003\u3000à .!😀漢0ñ")))), max_size=6))
def test_many_texts_agree_with_the_library(library, rows):
    encoder, _ = byte_bpe(PATH, PATTERN)
    ids, counts = encoder.many(pa.array(rows, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(rows)] == [library.encode_ordinary(t or "") for t in rows]


def test_long_words(library):
    ranks = read_ranks(PATH)
    rng = random.Random(4)
    for word in ("a" * 5_000, "".join(rng.choice("abcdefé") for _ in range(3_000)), "the" * 700, "ab", "x", ""):
        assert merge_word(word.encode(), ranks) == library.encode_ordinary(word)


def test_round_trip_of_rows(spark, documents, library):
    rows = [None, "", " ", "a  b\n c", "the same", "the same", "don't  stop", "w" * 30_000, "<|endoftext|>"]
    frame = round_trip(documents(rows, extra=True).drop("id"), PATH, PATTERN)
    for r in frame.collect():
        text = rows[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = encode_texts(documents(rows), PATH, PATTERN)
    back = decode_ids(encoded, PATH)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(rows)}


def test_real_texts(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        digests = (hashlib.sha256(x).hexdigest() for x in (struct.pack(f"<{len(ids)}I", *ids), r.text.encode()))
        want[r.doc_id] = (len(ids), *digests)
    assert {r[0]: tuple(r)[1:] for r in round_trip(docs, PATH, PATTERN).collect()} == want


def test_empty_table(spark, documents):
    assert round_trip(documents([]), PATH, PATTERN).count() == 0
