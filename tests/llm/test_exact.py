from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weirgate.llm.exact import Patricia, exact_dedup


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((key, text or ""))
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for key, _ in members:
            out.append((key, best[0], len(members), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect()), key=str)


def test_groups_agree_with_brute_force(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "ab", "b\tc", "", "é", "\n"]) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n"), (302, " \n"), (None, "a"), (303, "x" * 200_000), (304, "x " * 200_000)]
    result = exact_dedup(documents(rows, extra=True).repartition(7))
    assert result.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(result) == brute(rows)
    kept = {}
    for r in result.collect():
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_tries_that_outgrow_their_memory_give_the_same(spark, documents):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(800)]
    assert found(exact_dedup(documents(rows).repartition(5), trie_bytes=6_000, share_bytes=10_000)) == brute(rows)


def test_empty_table(spark, documents):
    assert exact_dedup(documents([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6)))
def test_trie_tells_strings_apart(keys):
    trie, seen = Patricia(), {}
    for key in keys:
        place = trie.find(key)
        assert seen.setdefault(key, place) is place
        place.entry = key
    assert sorted(trie.entries()) == sorted(set(keys))
