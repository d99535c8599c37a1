from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weirgate.llm.binary import Shard, read_token_files, write_shard, write_token_files
from weirgate.llm.bpe import Memory
from weirgate.llm.tokens import blank_encoder
from weirgate.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbB'sT.,!é É́İK \n\t\x0b\x0c\x1c\x85\xa0K12漢😀<|>"))))
def test_words_agree_with_the_library(library, text):
    assert list(memoryview(blank_encoder(PATH)(text.encode())).cast("I")) == library(text)


def test_many_texts_agree_with_the_library(library):
    rows = [None, "", " ", "One two", "x <|endoftext|> y", "<|startoftext|>A", "<|EndOfText|>", "a\u00a0b  c", "One two", "<|endoftext|>"]
    ids, counts = blank_encoder(PATH).many(pa.array(rows, pa.string()))
    assert np.split(ids, np.cumsum(counts)[:-1])[4].tolist() == library(rows[4])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in rows]


def test_plain_words_are_neither_remembered_nor_left_to_the_library(library, monkeypatch):
    words = [a + b for a in ("zqxva", "größe", "ñandúes", "straße") for b in ("", "***", "%%%,", "'", "_-", "&&&.")]
    encoder, asked = blank_encoder(PATH), []
    # Its memory is shared by the tests of this process.
    monkeypatch.setattr(encoder, "words", Memory(100))
    monkeypatch.setattr(encoder, "cores", Memory(100))
    real = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda new: asked.extend(new) or real(new))
    rows = [" ".join(words), "Größe*** \u00c9cole*** 12***", *words]
    ids, counts = encoder.many(pa.array(rows))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in rows]
    assert sorted(x for x in asked if any(map(str.isalnum, x))) == ["12***", "\u00c9cole"]
    assert not any(w.encode() in encoder.words.young for w in words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aZßñǰɏ'*_%<|>.\u0301\u0338 =\U0010fffdÉ1")))), max_size=5))
def test_plain_words_among_others_agree_with_the_library(library, rows):
    ids, counts = blank_encoder(PATH).many(pa.array(rows, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(rows)] == [library(t) for t in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(3, 6), max_size=60), min_size=1, max_size=8))
def test_shards_come_back(docs):
    parts = [[*d, 2] * 20 for d in docs]
    ids = np.array([x for p in parts for x in p], np.uint32)
    file = write_shard(ids, [*range(len(docs) - 1), None], [len(p) for p in parts], 10, 2)
    shard = Shard(file)
    assert shard.all_ids().tolist() == ids.tolist()
    assert [shard.document(i).tolist() for i in range(len(docs))] == parts
    assert shard.null.tolist() == [0] * (len(docs) - 1) + [1]


def test_frequent_pairs_are_replaced():
    ids = np.array(([7, 8, 9, 7, 8, 9, 7] * 200 + [2]) * 3, np.uint32)
    shard = Shard(write_shard(ids, [1, 2, 3], [1401] * 3, 10, 2))
    assert len(shard.symbols) < len(ids) / 50 and shard.all_ids().tolist() == ids.tolist()


def want(rows, library):
    out, start = {}, 0
    for i, text in rows:
        ids = [*library(text), 2]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def test_files_of_odd_rows(spark, documents, library):
    rows = [(None, "null id"), (0, None), (1, ""), (3, "It's a Test, isn't it?"), (9, "x" * 20_000), (10, " \n "), (11, "<|endoftext|>")]
    out = scratch_path(spark, "token-files")
    write_token_files(documents(rows[::-1], extra=True).drop("id").repartition(3), out, PATH)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, out).collect()}
    assert got == want(rows, library)


def test_equal_ids_and_empty_table(spark, documents):
    out = scratch_path(spark, "token-files")
    write_token_files(documents([(1, "a"), (1, "a"), (2, "b")]), out, PATH)
    assert sorted((r.id, r.start) for r in read_token_files(spark, out).collect()) == [(1, 0), (1, 2), (2, 4)]
    out = scratch_path(spark, "token-files")
    write_token_files(documents([]), out, PATH)
    assert read_token_files(spark, out).count() == 0


def test_real_texts(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scratch_path(spark, "token-files")
    write_token_files(docs, out, PATH)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, out).collect()} == want(rows, library)


def test_an_id_with_most_rows_is_spread(spark, library):
    rows = [(5, f"text {i} of one id") for i in range(3000)] + [(i, "another") for i in range(10, 60)] + [(1, "first")]
    out = scratch_path(spark, "token-files")
    # Small partitions aren't put together here.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), out, PATH)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(out).select("shard").distinct().count() > 3
    got = read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    assert [r.id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*library(t), 2], "<u4").tobytes() for _, t in rows)
