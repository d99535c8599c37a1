from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.llm.negatives import best_of, mine_hard_negatives, products, residues, small_primes


def plain(rows, every):
    good = [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, label, own) in enumerate(good):
        if anchor % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(own, v, strict=True)), i, b, other)
            for b, (i, other, v) in enumerate(good)
            if b != a and len(v) == len(own)
        )
        for top, positive, *_ in [s for s in scored if s[3] == label][:5]:
            window = [s for s in scored if s[3] != label and 80 * -top <= 100 * -s[0] <= 100 * -top][:5]
            out += [(anchor, positive, rank, s[1], -top, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(out)


def mined(frame, every, **options):
    got = mine_hard_negatives(frame, F.col("label"), F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


DDL = "vec_id long, label long, embedding array<double>"


@pytest.mark.parametrize("scale,dim", [(3, 1), (100, 64), (1 << 20, 7), (1 << 23, 700), (300, 3000)])
def test_products_are_exact(scale, dim):
    rng = np.random.default_rng(dim)
    one, two = rng.integers(-scale, scale + 1, (20, dim)), rng.integers(-scale, scale + 1, (30, dim))
    one[0], two[0] = scale, -scale
    bound = dim * scale * scale
    primes = small_primes(bound)
    got = products(residues(one, primes), residues(two, primes), primes)
    assert got.tolist() == [[sum(x * y for x, y in zip(a, b, strict=True)) for b in two.tolist()] for a in one.tolist()]
    assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * bound


def test_best_of_breaks_ties_by_id():
    none = np.iinfo(np.int64).min
    scores = np.array([[5, 5, 7, none, 5], [none] * 5, [1, none, none, none, none]])
    row, column = best_of(scores, np.array([9, 3, 8, 1, 4]), 3)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 1), (0, 4), (2, 0)]


@pytest.mark.parametrize("shard_bytes", [1 << 24, 2000])
def test_against_all_pairs(spark, shard_bytes):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, i % 5 if i % 3 else 1, [float(x) for x in centre[i % 6] + 0.3 * rng.normal(size=16)]) for i in range(500)]
    got = mined(spark.createDataFrame(rows, DDL), 20, shard_bytes=shard_bytes)
    assert got == plain(rows, 20) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.5]
    rows = [(0, 1, one), (0, 1, one), (0, 2, one), (2, 1, one), (3, 2, [0.9, 0.5]), (5, 2, [1.0, 0.4]), (None, 1, one), (4, None, one)]
    rows += [(6, 1, None), (8, 1, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (12, 1, []), (14, 2, []), (16, 1, [])]
    rows += [(18, 1, [-1.0, 0.0]), (20, 1, [2.0]), (22, 3, [1.0, 1.0, 1.0])] + [(7, 2, one)] * 9
    frame = spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], f"{DDL}, id string, shard int, dim int, row int")
    got = mined(frame, 2)
    assert got == plain(rows, 2) and got
    assert mined(frame.where("false"), 2) == []
    assert mined(frame.where("label = 1"), 2) == []


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(OverflowError):
        mined(spark.createDataFrame([(0, 1, [1e12]), (1, 1, [1.0])], DDL), 2)


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(300 + i, 0, rows[0][2]) for i in range(150)]
    got = mined(spark.createDataFrame(rows, DDL), 10, shard_bytes=1000)
    assert got == plain(rows, 10)
