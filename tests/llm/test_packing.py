from __future__ import annotations

import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weirgate.llm.common import utf8
from weirgate.llm.packing import Bins, pack_documents, pack_lengths
from weirgate.llm.tokens import LONGEST_PLAIN, TextEncoder, long_stretch, text_encoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_every_item_has_one_place(lengths):
    bins = pack_lengths(lengths, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 20 for b in bins)


def test_search_only_raises_squared_fill_and_saves_bins():
    rng = random.Random(5)
    saved = 0
    for _ in range(60):
        lengths = [rng.randrange(20, 70) for _ in range(60)]
        bins = Bins(100)
        for item in enumerate(lengths):
            at = bins.best_fit(item[1])
            bins.put(bins.open() if at < 0 else at, item[::-1])
        before = sum((100 - g) ** 2 for g in bins.gap), sum(map(bool, bins.held))
        bins.search()
        assert sum((100 - g) ** 2 for g in bins.gap) >= before[0]
        assert sum(map(bool, bins.held)) <= before[1]
        saved += before[1] - sum(map(bool, bins.held))
    assert saved > 0


def step_left(bins):
    """A move, or an exchange of one or two documents for a smaller one, that takes tokens into a fuller bin."""
    for at, own in enumerate(bins.held):
        for to, theirs in enumerate(bins.held):
            if at == to or not own or not theirs or bins.gap[at] < bins.gap[to]:
                continue
            if any(x[0] <= bins.gap[to] for x in own):
                return "move"
            if bins.gap[at] == bins.gap[to]:
                continue
            given = [*itertools.combinations(own, 1), *itertools.combinations(own, 2)]
            for out, back in itertools.product(given, theirs):
                if 0 < sum(x[0] for x in out) - back[0] <= bins.gap[to]:
                    return out, back
    return None


@pytest.mark.parametrize("least,most", [(20, 70), (1, 30), (3, 12), (30, 36)])
def test_no_step_is_left(least, most):
    rng = random.Random(least)
    for _ in range(15):
        bins = Bins(100)
        for i in range(80):
            at = rng.choice([x for x, g in enumerate(bins.gap) if g >= most] or [-1])
            bins.put(bins.open() if at < 0 or rng.random() < 0.2 else at, (rng.randrange(least, most), i))
        bins.search()
        assert step_left(bins) is None
        assert sorted(i for own in bins.held for _, i in own) == list(range(80)) and min(bins.gap) >= 0


def test_rows_with_equal_ids(spark, library):
    rows = [(7, "a b c " * n) for n in (1, 1, 50, 400)] + [(None, "x"), (8, "y")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN, size=64).collect()
    want = sorted(len(library(text)) for _, text in rows)
    starts = [r for r in got if r.piece == 0]
    assert len(starts) == len(rows) and sum(r.length for r in got) == sum(want)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def check(frame, want, size):
    rows = frame.collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc, ids in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == size for p in pieces[1:])
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert set(by_doc) == set(want)
    return len(by_sequence), sum(r.length for r in rows)


def test_odd_rows(spark, documents, library):
    rows = [None, "", "a b", "a b", "x " * 1500, "  two  spaces \n ", "w" * 9000, "<|endoftext|>", "a <|endoftext|> b  <|EndOfText|>", "\u00a0 x\u3000 y"]
    frame = pack_documents(documents(rows, extra=True), PATH, PATTERN, size=64)
    check(frame, {i: library(t) for i, t in enumerate(rows)}, 64)
    assert pack_documents(documents([]), PATH, PATTERN).count() == 0


def test_real_texts_are_packed_tightly(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    sequences, tokens = check(pack_documents(docs, PATH, PATTERN), want, 1024)
    assert sequences <= -(-tokens // 1024) * 1.02 + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab' tsdé1 \n\t\x0b\x1c\x85\xa0\u2003\u3000à .!😀漢0ñ\ufeff\x00")))), max_size=5))
def test_whole_texts_agree_with_the_library(library, rows):
    encoder = text_encoder(PATH, PATTERN)
    assert isinstance(encoder, TextEncoder)
    ids, counts = encoder.many(pa.array(rows, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(rows)] == [library(t)[:-1] for t in rows]


def test_odd_texts_agree_with_the_library(library):
    rows = ["<|endoftext|>", "x <|EndOfText|> y", "q" * 5000 + " end", "a" + " " * 5000 + "b", "é" * 3000, "one\n" * 3000, "don't"]
    encoder = text_encoder(PATH, PATTERN)
    ids, counts = encoder.many(pa.array(rows, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t)[:-1] for t in rows]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in rows)])
    assert long_stretch(data, offsets, LONGEST_PLAIN).tolist() == [False, False, True, True, True, True, False]


def test_stretches_are_found_at_little_cost():
    """The texts are looked through once; that took as long as encoding them when the places of all spaces were sorted."""
    rng = np.random.default_rng(3)
    rows = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 20, 6000)) for _ in range(100)]
    encoder, column = text_encoder(PATH, PATTERN), pa.array(rows)
    encoder.many(column[:1])

    def least(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    data, offsets = utf8(column)
    assert 5 * least(lambda: long_stretch(data, offsets, LONGEST_PLAIN)) < least(lambda: [encoder.encoding.encode_to_numpy(t) for t in rows])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=12), max_size=6), st.integers(1, 5))
def test_stretches_of_any_texts(rows, most):
    data, offsets = utf8(pa.array(rows, pa.string()))
    want = [any(len(x.encode()) > most for x in re.findall(" +|[^ ]+", t)) for t in rows]
    assert long_stretch(data, offsets, most).tolist() == want
