from __future__ import annotations

import hashlib
import random

import pytest

from weirgate.llm import windows
from weirgate.llm.windows import remove_repeated_windows


def brute(rows, depth):
    counts = {}
    bodies = [(t or "").encode() for _, t in rows]
    for body in bodies:
        for i in range(len(body) - depth + 1):
            w = body[i : i + depth]
            counts[w] = counts.get(w, 0) + 1
    out = []
    for (key, _), body in zip(rows, bodies, strict=True):
        gone = bytearray(len(body))
        for i in range(len(body) - depth + 1):
            if counts[body[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        kept = bytes(b for b, x in zip(body, gone, strict=True) if not x)
        out.append((key, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def mixed(seed, depth):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    line = lambda n: "".join(word() for _ in range(n))
    passages = [line(depth // 2) for _ in range(4)]
    texts = []
    for _ in range(80):
        parts = [line(rng.randrange(depth // 4)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(20) :])
        texts.append("".join(parts))
    for text in texts[:20]:
        at = rng.randrange(len(text))
        texts.append(text[:at] + "#" + text[at + 1 :])
        texts.append(text[at // 3 :])
    texts += texts[:5]
    texts += [None, "", "x", "a" * (3 * depth), "a" * (depth + 1), "ab" * depth, passages[0] + passages[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize(("depth", "many"), [(80, 8192), (100, 3), (30, 8192)])
def test_agrees_with_all_windows(spark, documents, monkeypatch, depth, many):
    monkeypatch.setattr(windows, "MANY", many)
    monkeypatch.setattr(windows, "SORT_BYTES", 3_000)
    rows = mixed(depth, depth)
    rows += [(None, rows[0][1]), (5, rows[5][1])]
    result = remove_repeated_windows(documents(rows, extra=True).drop("id").repartition(5), depth=depth)
    assert result.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(result) == brute(rows, depth)


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(remove_repeated_windows(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_text_that_is_left(spark, documents):
    rows = remove_repeated_windows(documents(["ab" + "é" * 20, "cd" + "é" * 20, "z"]), depth=20, with_text=True)
    assert {r.doc_id: r.kept_text for r in rows.collect()} == {0: "ab", 1: "cd", 2: None}


def test_empty_table(spark, documents):
    assert remove_repeated_windows(documents([])).count() == 0
