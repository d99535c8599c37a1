from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from weirgate.llm.toxicity import DECAY, LONGEST_WORD, SIGNS, SPREAD, held_out, kernels, line, margins, plain, score, spectrum, train, windows


def plain_spectrum(window):
    out, norm = {}, 0.0
    for a, b, c in itertools.combinations(range(len(window)), 3):
        if c - a < SPREAD:
            key = window[a] + window[b] + window[c]
            out[key] = out.get(key, 0) + DECAY ** (c - a + 1)
            norm += DECAY ** (2 * (c - a + 1))
    return {k: v / norm**0.5 for k, v in out.items()}


def test_kernel_agrees_with_its_definition():
    examples = [" idiot ", " id iot ", " idioot ", " banana ", " ana ", " xyz on ", "nananan"]
    landmarks = [" idiot ", " ananas ", " on "]
    want = [[sum(v * plain_spectrum(t).get(k, 0) for k, v in plain_spectrum(s).items()) for t in landmarks] for s in examples]
    assert np.allclose(kernels(examples, landmarks), want, atol=1e-5)
    assert (kernels([" ", "ab"], landmarks) == 0).all()


def test_margins_of_windows_are_sums_over_their_subsequences():
    weights = np.random.default_rng(1).normal(size=SIGNS**3).astype(np.float32)
    plains = ["one two three", "", "a", "x" * 100 + " end", "é ß 7 日本"]
    signs, starts = line(plains)
    begin, end, own = windows(signs, starts)
    got = margins(signs, begin, end, weights)
    for a, b, text, value in zip(begin, end, own, got, strict=True):
        shown = f" {plains[text]} "[a - starts[text] : b - starts[text]]
        index, weight = spectrum(shown)
        assert value == pytest.approx(float(weights[index] @ weight), abs=1e-4)


def test_windows_are_words_and_neighbours():
    plains = ["one two three", "", "a", "x" * 100 + " end"]
    signs, starts = line(plains)
    found = [(t, f" {plains[t]} "[a - starts[t] : b - starts[t]]) for a, b, t in zip(*windows(signs, starts), strict=True)]
    assert [w for t, w in found if t == 0] == [" one ", " one two ", " two ", " two three ", " three "]
    assert [w for t, w in found if t in (1, 2)] == [" a "]
    pieces = [w for t, w in found if t == 3]
    assert pieces[-1] == " end " and all(len(w) <= LONGEST_WORD for w in pieces)
    assert all(any(" " + "x" * 100 + " " == w or w in " " + "x" * 100 + " " for w in pieces) for _ in pieces)


def test_marks_and_spelled_words():
    assert plain("You, I d i o t there!") == "you idiot there" and plain("a b") == "a b"
    assert plain("an i.d.i.o.t and an i*d*i*o*t.") == "an idiot and an idiot" and plain("snake_case  x") == "snakecase x"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    sounds = ["an", "er", "th", "on", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randrange(1, 5)))
    insults = ["gronkel", "blifwax", "puzdrom"]
    rows, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(insults)
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_insults_are_found_with_gaps_and_inserted_signs(spark, world):
    docs, labels, known = world
    model = train(docs, labels)
    got = {r.doc_id: r.score for r in score(docs.where(held_out(docs.doc_id)), model).collect()}
    assert got and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got)
    assert all((s >= 0.3) == bool(known[i]) for i, s in got.items())
    odd = ["the g.r.o.n.k.e.l re", "g r o n k e l", "GRONKEL!", "grxonkel", "an puz*drom an", "the heredon", "", None, " ", "x" * 5000, "he gron kel on"]
    odd.append(" ".join(["heredon"] * 30_000) + " blifwax")
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "1 AS label", "'x' AS word")
    rows = {r.doc_id: r.score for r in score(frame, model).collect()}
    assert [rows[i] >= 0.3 for i in range(len(odd))] == [True, True, True, True, True, False, False, False, False, False, True, True]


def test_labels_of_held_out_rows_are_not_read(spark, world):
    docs, labels, _ = world
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = train(docs, labels), train(docs, flipped)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.curve, two.curve)


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents(["a b c", None])
    for rows, want in (([(0, 0), (1, None)], 0), ([(0, 1)], 1), ([], 0)):
        model = train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [round(r.score) for r in score(docs, model).collect()] == [want, want]
    assert score(documents([]), model).count() == 0


def test_repeated_ids_and_ties(spark, world):
    docs, labels, _ = world
    several = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' zz') AS text")).unionByName(docs).selectExpr("*", "1 AS label", "2 AS part")
    twice = labels.unionByName(labels).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS int) AS toxic"))
    one, two = train(docs, labels), train(several, twice)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.curve, two.curve)


@pytest.mark.parametrize("folder,least,share", [("sf0.01", 0.6, 0.9), ("sf0.1", 0.8, 0.85)])
def test_held_out_accuracy_on_the_table(spark, folder, least, share):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = score(docs, train(docs, labels)).where(held_out(F.col("doc_id"))).join(labels, "doc_id").select("toxic", "score").toPandas()
    found, toxic = scored.score >= 0.3, scored.toxic == 1
    recall, precision = (found & toxic).sum() / toxic.sum(), (found & toxic).sum() / found.sum()
    assert recall >= least and precision >= share
    # Ten telling words alone have a recall of 0.52 at a precision of 1 on sf0.1; a constant is wrong for every toxic one.
    assert (found != toxic).mean() < 0.4 * toxic.mean()
