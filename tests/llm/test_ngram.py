from __future__ import annotations

import itertools
import random

import numpy as np

import pytest

from weirgate.llm import ngram
from weirgate.llm.components import components
from weirgate.llm.ngram import ngram_jaccard_join


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if common and 100 * common >= 80 * (len(one) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_copies(seed, bases=6, copies=60):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        texts += [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(copies)]
        texts += [" ".join(base[: len(base) // 2] + passage + base[len(base) // 2 :]).upper() for _ in range(3)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 16])
def test_components_agree_with_all_pairs(spark, documents, monkeypatch, block):
    monkeypatch.setattr(ngram, "BLOCK", block)
    rows = near_copies(block)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A\tB"), (1005, "a b c"), (1005, "a b c"), (None, "x y z q r s")]
    rows += [(1006, "long " + " ".join(str(i) for i in range(40_000))), (1007, " ".join(str(i) for i in range(40_000)))]
    result = ngram_jaccard_join(documents(rows, extra=True).drop("id").repartition(6))
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(result) == brute(rows)


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(ngram_jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, documents):
    assert ngram_jaccard_join(documents([])).count() == 0


def test_rows_name_one_row_per_group(spark, documents):
    frame = documents([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, ""), (7, "")]).selectExpr("*", "monotonically_increasing_id() AS r")
    rows = ngram_jaccard_join(frame, row_col="r").collect()
    kept = sorted((r.doc_id for r in rows if r.r == r.component_row), key=str)
    assert kept == [5, 7, None]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    labels = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 260)}


def test_a_pair_is_verified_once_and_only_if_its_summaries_allow_it(spark, documents, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(30):
        own = rng.sample(base, 120)
        for _ in range(12):
            words = list(own)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(120)] = rng.choice(base)
            rows.append(" ".join(words))
    # A passage that many otherwise different texts have.
    passage = rng.sample(base, 30)
    rows += [" ".join(rng.sample(base, 90) + passage) for _ in range(120)]
    tables = []
    kept = ngram.written
    monkeypatch.setattr(ngram, "written", lambda df, name: tables.append((name, kept(df, name))) or tables[-1][1])
    got = {r.doc_id: r.component_id for r in ngram.ngram_jaccard_join(documents(rows)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            linked += 1
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert got == {i: root(i) for i in range(len(rows))} and linked > 100
    asked = [(r.a, r.b) for name, table in tables if name == "ngram-asked" for r in table.select("a", "b").collect()]
    assert asked and all(a < b for a, b in asked) and len(asked) == len(set(asked))
    assert len(asked) < 3 * len(rows)


def test_summaries_never_understate_what_sets_share():
    rng = np.random.default_rng(2)
    for n, m, common in ((10, 12, 9), (500, 450, 430), (5000, 4000, 0), (3000, 1500, 1500), (1, 1, 1)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2))
        one, two = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : n + m - common])))
        most = ngram.most_common(ngram.ranges(one), ngram.ranges(two))
        assert most >= len(np.intersect1d(one, two))
        if not common:
            assert most < 0.8 * min(n, m)
    crowded = np.arange(300, dtype=np.uint64)
    assert ngram.ranges(crowded) == b"" and ngram.most_common(b"", ngram.ranges(pool)) is None
