from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from weirgate.llm import merkle
from weirgate.session import scratch_path

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain(rows):
    """All proofs of a table, by whole levels held in memory."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, i):
        for level in tree[:-1]:
            s = i - i % 3
            yield i - s, level[s:i] + level[i + 1 : s + 3]
            i //= 3

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    trees = {}
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[source] = (own, levels([leaf_of(r) for r in own]))
    top = levels([tree[-1][0] for _, tree in trees.values()])
    out = []
    for g, (own, tree) in enumerate(trees.values()):
        for i, row in enumerate(own):
            path = [*way(tree, i), *way(top, g)]
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of((*row[:4], text))
            for place, others in path:
                node = h("".join(others[:place]) + node + "".join(others[place:]))
            proof = h("".join(x for _, others in path for x in others))
            out.append((row[0], leaf_of(row), tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def result(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, FIELDS)
    if extra:
        for name in ("tree", "pos", "id", "leaf", "row", "part", "root", "block", "carried"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
    got = merkle.verify_tampering(frame, scratch_path(spark, "merkle"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("height", range(8))
def test_addresses_are_a_layout_with_whole_subtrees(height):
    every = [merkle.address(height, d, np.arange(3**d)) for d in range(height + 1)]
    assert sorted(np.concatenate(every)) == list(range(merkle.nodes_of(height))) and every[0][0] == 0
    # Each lower subtree of the first cut is one run of addresses.
    upper = (height + 1) // 2
    if upper:
        for root in range(3**upper):
            own = np.concatenate([every[d][root * 3 ** (d - upper) : (root + 1) * 3 ** (d - upper)] for d in range(upper, height + 1)])
            assert sorted(own) == list(range(own.min(), own.min() + len(own)))


def test_groups_of_any_size(spark):
    sizes = (1, 2, 3, 4, 9, 10, 27, 728, 729, 730, 1459, 2200)
    rows = [(1000 * g + i, f"s{g}", "en", 3, f"a\n{i}" if i % 3 else None) for g, n in enumerate(sizes) for i in range(n)]
    assert order(result(spark, rows)) == order(plain(rows))


def test_one_group_and_many_small_ones(spark):
    assert order(result(spark, [(5, "s", "en", 1, "a\n")])) == order(plain([(5, "s", "en", 1, "a\n")]))
    # More groups than a block of the upper tree has leaves, and a hot one.
    rows = [(i, None if i % 400 == 0 else "hot" if i % 3 else f"s{i}", None, i, "x" * (i % 7) + "\n") for i in range(3000)]
    assert order(result(spark, rows)) == order(plain(rows))


def test_odd_rows(spark):
    rows = [
        (None, "a", None, None, None),
        (None, "a", "", 0, ""),
        (1, None, "en", 1, "ü\n"),
        (1, "", "en", 1, "ü\n"),
        (2, "é", "en", 1, "日本\n語" * 50_000),
        (2, "é", "en", 1, "b"),
        (-3, "z", "en", -1, "\n\n"),
        *[(7, "z", "en", 1, "same\n")] * 40,
        (8, "Z", "en", 1, "\r\n"),
    ]
    assert order(result(spark, rows, extra=True)) == order(plain(rows))


def test_an_empty_table(spark):
    assert result(spark, []) == []


def test_a_proof_read_again_by_path(spark):
    path = scratch_path(spark, "merkle")
    rows = [(i, "s", "en", 1, str(i)) for i in range(40)]
    merkle.build_manifest(spark.createDataFrame(rows, FIELDS), path)
    for row in merkle.proofs(spark, path).collect():
        assert merkle.fold(row.leaf, row.shape, row.siblings) == row.root
        assert merkle.fold(bytes(32), row.shape, row.siblings) != row.root


def test_the_whole_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source", "lang", "cast(n_chars AS long) n_chars", "text")
    rows = [tuple(r) for r in frame.collect()]
    got = result(spark, rows)
    assert order(got) == order(plain(rows))
    assert {v for *_, v in got} == {True, False}
