from __future__ import annotations

import io
import math
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirgate.llm import lm
from weirgate.llm.lm import GROWTH, Shard, language_model_scores, pack, unpack
from weirgate.llm.plans import op13_lm_scores
from weirgate.llm.trie import EliasFano, Trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    """The same model out of dictionaries, without quantisation."""

    def __init__(self, rows):
        self.one, self.two, self.three, self.after = Counter(), Counter(), Counter(), Counter()
        for i, text in rows:
            if not held(i):
                line = self.line(text)
                for a, b, c in zip(line, line[1:], line[2:]):
                    self.one[c] += 1
                    self.two[b, c] += 1
                    self.three[a, b, c] += 1
                    self.after[b] += 1
                    self.after[a, b] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    @staticmethod
    def line(text):
        return ["<", "<", *re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]

    def base(self, c):
        return (self.one[c] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def word(self, a, b, c):
        p = self.base(c)
        for context, times, growth in ((b, self.two[b, c], GROWTH[0]), ((a, b), self.three[a, b, c], GROWTH[1])):
            n = self.after[context]
            if n:
                p = (times + n**growth * p) / (n + n**growth)
        return p

    def row(self, i, text):
        line = self.line(text)
        words = line[2:]
        base = sum(math.log10(self.base(c)) for c in words)
        score = sum(math.log10(self.word(a, b, c)) for a, b, c in zip(line, line[1:], line[2:]))
        return held(i), len(words), sum(self.one[c] > 0 for c in words), self.n, base, score


def agrees(frame, rows):
    learned = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 != 1
    got = language_model_scores(frame, learned).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    model = Plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 2) for x in r[5:]))
    want = sorted(((i, *model.row(i, text)) for i, text in rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # Half a step of a quantised probability for each word, at most twice.
        assert g[6] == pytest.approx(w[6], abs=w[2] / 4096 + 1e-9)
    return got


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 5), (5, 3), (100, 10), (1000, 10**9), (5000, 2**50), (70, 70), (1000, 5)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    kept = EliasFano.of(values)
    assert kept[np.arange(n)].tolist() == values.tolist()
    asked = np.concatenate((values, values + 1, np.maximum(values - 1, 0), rng.integers(0, 2 * top + 2, 200), [0, 2**52]))
    assert kept.successor(asked).tolist() == np.searchsorted(values, asked).tolist()


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 2**30, 100_000))
    bits = 8 * sum(a.nbytes for a in EliasFano.of(values).arrays()) / len(values)
    assert bits < 2 + math.log2(2**30 / 100_000) + 3


def test_a_mapped_trie_finds_what_it_has_and_nothing_else():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    heads = sorted({a for a, _ in pairs})
    parents = [np.zeros(len(heads), np.int64), np.array([heads.index(a) for a, _ in pairs])]
    trie = Trie.of([np.array(heads), np.array([b for _, b in pairs])], parents, [[], [np.arange(len(pairs), dtype=np.uint16)]])
    with tempfile.TemporaryFile() as file:
        trie.save(file)
        again = Trie.mapped(file)
        asked = np.array([(a, b) for a in range(62) for b in range(62)])
        found = again.find(1, again.find(0, np.zeros(len(asked), np.int64), asked[:, 0]), asked[:, 1])
        assert found.tolist() == [pairs.index((a, b)) if (a, b) in pairs else -1 for a, b in asked.tolist()]
    none = Trie.of([np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [[], [np.zeros(0, np.uint16)]])
    none.save(io.BytesIO())
    assert none.find(1, none.find(0, np.zeros(2, np.int64), np.array([1, 2])), np.array([1, 2])).tolist() == [-1, -1]


def test_packed_numbers():
    arrays = [np.array(x, np.int64) for x in ([], [0], [255, 0], [256], [1 << 40, 3], list(range(1000)))]
    assert [x.tolist() for x in unpack(pack(arrays))] == [x.tolist() for x in arrays]


def test_the_model_is_a_distribution():
    model = Plain([(i, "a b c a b d a b") for i in (0, 2, 3)] + [(4, "b a")])
    for a, b in [("<", "<"), ("a", "b"), ("b", "zz"), ("c", "a")]:
        total = sum(model.word(a, b, c) for c in model.one) + model.word(a, b, "never seen")
        assert total == pytest.approx(1.0)


def test_odd_rows(spark, documents):
    rows = [None, "", " \t\n", "One two\x0bthree", "one TWO three one two four", "Ä ä İ  x", "x" * 100_000, (None, "one two"), (None, None)]
    rows += [(7, "one two three")] * 30 + [(8, "word " * 60_000), "nul\x00 byte", "\U0001f600 \U0001f600"]
    pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    agrees(documents(rows, extra=True), pairs)


def test_empty_tables(spark, documents):
    assert agrees(documents([]), []) == []
    everything_held_out = [(i, "a b") for i in range(400) if held(i)]
    agrees(documents(everything_held_out), everything_held_out)


def test_the_query_on_the_whole_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = agrees(frame.repartition(5), rows)
    query = op13_lm_scores(spark, sf_dir)
    assert query.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(tuple(r) for r in query.select(*query.columns[:5]).collect()) == [g[:5] for g in got]


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (rows[1] - rows[0]) / rows[2] > 0.2


@pytest.mark.parametrize("shift", [0, 1 << 33])
def test_a_shard_adds_up_what_chunks_learned(shift):
    # Two chunks: first words (differences), their runs, their counts, second words, counts, followers, third words, counts.
    one = [[3 + shift, 4], [2, 1], [10, 5], [2, 9 + shift, 2], [1, 2, 0], [1, 2, 0], [8, 4, 5], [1, 0, 2]]
    two = [[7 + shift], [1], [5], [2], [3], [1], [6 + shift], [3]]
    asked = [[np.array(x, np.int64) for x in chunk] for chunk in (one, two)]
    shard = Shard([unpack(pack(a), wide=False) for a in asked])
    pairs = {(3 + shift, 2): (1, 10), (3 + shift, 9 + shift): (2, 10), (7 + shift, 2): (3, 5)}
    times = [(1, 1), (0, 2), (2, 2), (3, 3)]
    with tempfile.TemporaryFile() as file:
        shard.trie().save(file)
        first, rest, last = shard.look_up(Trie.mapped(file))
    got = [10.0 ** (-(int(c) - 1) / 4096) if c else 0.0 for c in first[shard.pair]]
    want = [n / (total + total ** GROWTH[0]) for n, total in (pairs[3 + shift, 2], pairs[3 + shift, 9 + shift], pairs[7 + shift, 2], pairs[7 + shift, 2])]
    assert got == pytest.approx(want, rel=1e-3)
    got = [10.0 ** (-(int(c) - 1) / 4096) if c else 0.0 for c in last[shard.triple]]
    assert got == pytest.approx([n / (total + total ** GROWTH[1]) for n, total in times], rel=1e-3)
    assert (rest > 0).all()


def test_word_lists_are_gone_before_their_numbers_are_sent():
    words = [f"{'word' * 20}{i}" for i in range(20_000)]

    def row(chunk, own):
        joined = " ".join(own).encode()
        text = pa.compress(joined, lm.CODEC, asbytes=True)
        counts = lm.pack([np.ones(len(own), np.int64), np.full(len(own), 2)])
        return {"chunk": chunk, "part": 0, "data": np.array([len(joined), len(text)], "<i8").tobytes() + text + counts}

    rows = [row(0, words), row(1, words[::-2])]
    batch = pa.RecordBatch.from_pylist(rows, schema=lm.SENT)
    before = pa.total_allocated_bytes()
    found = lm._numbers(1)(iter([batch]))
    sent = [next(found)]
    assert pa.total_allocated_bytes() - before < sum(map(len, words)) // 2
    sent += found
    totals, *of_chunks = ([lm.unpack(d) for d in b.column("data").to_pylist()][0] for b in sent)
    assert totals[0].tolist() == [20_000, 30_000]
    number, counts, total = of_chunks[0]
    assert sorted(number.tolist()) == list(range(lm.FIRST, lm.FIRST + 20_000))
    assert set(counts.tolist()) == {1, 2} and set(total.tolist()) == {2, 4}
    assert of_chunks[1][0].tolist() == number[::-2].tolist()
