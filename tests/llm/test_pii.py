from __future__ import annotations

import random
import re

from weirgate.llm.pii import find_pii, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(digits[::-1]))
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def found(frame, kinds=tuple(BASE)):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind in kinds] for r in frame.collect()}


def test_base_spans_agree_with_plain_patterns(spark, documents):
    rng = random.Random(3)
    signs = ["a", "b.", "@", "x@y.z", "é", "1", "23", ".", "+", "-", " ", "(", "\n", "10.0.0.1", "4587121519400672", "+1 (255) 555-8013", "😀"]
    rows = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    rows += [None, "", "a@b.c-d@e.f_g@h.i", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "0" * 50_000]
    rows += ["a" * 50_000 + "@", "1 " * 20_000, "+1 " + "2 3" * 4, "9" * 60 + ".1.1.1", "000255.1.1.1"]
    rows += [" ".join(["a@b.c 1.1.1.1"] * 2_000)]
    frame = find_pii(documents(rows))
    assert found(frame) == {i: brute(t) for i, t in enumerate(rows)}


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert found(find_pii(docs)) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_checksums_and_context_add_spans(spark, documents):
    rows = ["IBAN DE89370400440532013000.", "IBAN DE89370400440532013001.", "ssn 123-45-6789", "no 123-45-6789", "GB82 WEST 1234 5698 7654 32"]
    got = found(find_pii(documents(rows)), ("iban", "ssn"))
    assert got == {0: [("iban", 5, 27)], 1: [], 2: [("ssn", 4, 15)], 3: [], 4: [("iban", 0, 27)]}


def test_account_numbers_end_where_their_country_says(spark, documents):
    plain, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    before = ["IBAN ", "Reference SE14 ", "IBAN\u00a0", "iban 4 XX "]
    after = [" Please pay", " BIC COBADEFFXXX", " AND then", " 2024", " 2024 AND 7 MORE", ".", "", ", B 1", " GB82 WEST 1234 5698 7654 32"]
    rows, want = [], []
    for number in (plain, spaced, "NO9386011117947", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S", "FR1420041010050500013M02606"):
        for b in before:
            for a in after:
                rows.append(b + number + a)
                want.append([("iban", len(b), len(b + number))] + ([("iban", len(b + number) + 1, len(rows[-1]))] if "WEST" in a else []))
    for start, number in [("SE14 ", "GB82 WEST 1234 5698 7654 32"), ("AT61 ", spaced)]:
        rows.append(f"iban {start}{number}")
        want.append([("iban", 10, 10 + len(number))])
    rows += ["iban DE89370400440532013000x", "iban DE893704004405320130001", "iban DE89 3704 0044 0532 0130 01 A"]
    want += [[], [], []]
    got = found(find_pii(documents(rows)), ("iban",))
    assert got == dict(enumerate(want))
    text = redact(find_pii(documents([f"IBAN {spaced} BIC COBADEFFXXX"]))).first().text
    assert text == "IBAN [IBAN] BIC COBADEFFXXX"


def test_redact_hides_spans_and_keeps_the_rest(spark, documents):
    rows = ["write to é.x@y.org now", "clean é text", None, "", "+1 255 10.0.0.1 99", "a@b.co,1.1.1.1"]
    frame = redact(find_pii(documents(rows, extra=True).drop("pii")))
    assert [r.text for r in frame.orderBy("doc_id").collect()] == [
        "write to é[EMAIL] now",
        "clean é text",
        None,
        "",
        "[PHONE]",
        "[EMAIL],[IP]",
    ]


def test_empty_table(spark, documents):
    assert find_pii(documents([])).count() == 0
