"""Repeated byte windows: a depth-limited radix sort of the suffixes that can be repeated.

A window is ``depth`` bytes from a place on. Its anchor is its smallest hashed gram, the leftmost of
equal ones: equal windows have equal anchors at equal offsets. Consecutive windows with one anchor
are a *unit*, told apart by its bytes' hash (128 bits); units are what is shuffled, about one for 170
bytes. That is the radix sort's first digit. It settles most of the input: windows of a gram that
occurs once aren't repeated, and where all units of a gram are equal, all their windows are.

Only where unequal units share a gram, one example of each comes together with its bytes, and its
suffixes are sorted through ``depth`` bytes, a digit of 50 bytes a pass, group by group; a suffix that
is alone in its group drops out. Groups that remain after the last digit are the repeated windows.
A gram with very many unequal units isn't sorted in one task: its windows are counted by hash, which
Spark adds up before it shuffles.

Copies of a text are folded per task and looked at once. Places and counts are of UTF-8 bytes; windows
don't cross texts. Defined cases: a null text is empty; a text shorter than ``depth`` has no windows;
rows with equal ids are different documents, so their texts repeat each other. An empty table gives no
rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out, steps, utf8, written
from .shingles import BYTE_BASE, WORD_BASE, mix, powers

GRAM = 64
DIGIT = 50
# Texts that a task folds at once; bytes of units that are sorted together.
FOLD, SORT_BYTES = 4_000, 1 << 20
# Unequal units of one gram that are sorted in one task.
MANY = 8_192
# Slots of the table that tells which texts are asked for: so many numbers are broadcast at most.
SLOTS = 1 << 20
NO_KEY = -(1 << 63)
# Low bits of a gram's hash that make room for its place.
PLACE_BITS = 28

UNIT = ("gram", "offset", "windows", "h1", "h2")
TEXTS = pa.schema(
    [
        ("h", pa.int64()),
        ("n", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("rows", pa.list_(pa.int64())),
        ("least_id", pa.int64()),
        ("sha", pa.string()),
        ("start", pa.list_(pa.int64())),
        ("gram", pa.list_(pa.int64())),
        ("offset", pa.list_(pa.int32())),
        ("windows", pa.list_(pa.int32())),
        ("h1", pa.list_(pa.int64())),
        ("h2", pa.list_(pa.int64())),
    ]
)
TEXTS_DDL = (
    "h long, n long, ids array<long>, rows array<long>, least_id long, sha string, start array<long>, gram array<long>,"
    " offset array<int>, windows array<int>, h1 array<long>, h2 array<long>"
)
SPANS = pa.schema([("gram", pa.int64()), ("offset", pa.int32()), ("windows", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("froms", pa.list_(pa.int64())), ("tos", pa.list_(pa.int64()))])
SPANS_DDL = "gram long, offset int, windows int, h1 long, h2 long, froms array<long>, tos array<long>"
HASHED = pa.schema([("gram", pa.int64()), ("offset", pa.int32()), ("windows", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
HASHED_DDL = "gram long, offset int, windows int, h1 long, h2 long, at int, w1 long, w2 long"
KEPT = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


class Rolling:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), dtype=np.uint64, out=self.sums[1:])
        self.down = powers(inverse, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` keys in a row."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def units_of(data: np.ndarray, offsets: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """The units of texts that lie one after the other: the text, start in it, and what identifies each."""
    gram = min(GRAM, depth)
    none = {k: np.zeros(0, np.int64) for k in ("text", "start", *UNIT)}
    if len(data) < depth:
        return none
    one, two = Rolling(data, BYTE_BASE), Rolling(data, WORD_BASE)
    at = np.arange(len(data) - gram + 1)
    hashes = one(at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (sliding_least(hashes & ~low | at.astype(np.uint64), depth - gram + 1) & low).astype(np.int64)
    # Windows that end in the text they start in.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + depth <= offsets[1:][text]
    places = np.flatnonzero(inside)
    if not len(places):
        return none
    anchor = anchor[places]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)))
    first = np.flatnonzero(new)
    start, windows = places[first], np.diff(np.append(first, len(places)))
    end = start + windows - 1 + depth
    return {
        "text": text[start],
        "start": start - offsets[text[start]],
        "gram": hashes[anchor[first]].view(np.int64),
        "offset": anchor[first] - start,
        "windows": windows,
        "h1": one(start, end).view(np.int64),
        "h2": two(start, end).view(np.int64),
    }


def _texts(depth: int):
    """First pass: the different texts of a task, with their units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def table() -> pa.RecordBatch:
            rows = [
                (h, n, ids, own, min((i for i in ids if i is not None), default=None), sha, *arrays)
                for (h, n, sha), (ids, own, arrays) in held.items()
            ]
            return rows_out(TEXTS, list(zip(*rows, strict=True)) if rows else [[]] * len(TEXTS))

        for batch in steps(batches, "text"):
            data, offsets = utf8(batch.column(4))
            shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), shas, strict=True))
            units = None
            for i, (key, doc, row) in enumerate(zip(keys, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                entry = held.get(key)
                if entry is None:
                    if units is None:
                        units = units_of(data, offsets, depth)
                        cuts = np.searchsorted(units["text"], np.arange(len(offsets)))
                    arrays = [units[k][cuts[i] : cuts[i + 1]] for k in ("start", *UNIT)]
                    entry = held[key] = [[], [], arrays]
                entry[0].append(doc)
                entry[1].append(row)
            if len(held) > FOLD:
                yield table()
                held = {}
        yield table()

    return run


def repeated_windows(data: np.ndarray, start: np.ndarray, gram: np.ndarray, offset: np.ndarray, windows: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Whether each window of some units (one after the other) is repeated among them.

    Most significant digit first: windows of one group are told apart by their next 50 bytes; those that
    are alone, with a unit that occurs once, are done.
    """
    unit = np.repeat(np.arange(len(start)), windows)
    step = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
    place, away = start[unit] + step, offset[unit] - step
    repeated = np.zeros(len(unit), bool)
    rolling = Rolling(data, BYTE_BASE)
    left = np.arange(len(unit))
    group = mix(gram.view(np.uint64)[unit] + away.astype(np.uint64) * WORD_BASE)
    for at in range(0, depth, DIGIT):
        digit = rolling(place[left] + at, place[left] + min(depth, at + DIGIT))
        group = mix(group * WORD_BASE + digit)
        order = np.argsort(group, kind="stable")
        same = np.concatenate(([True], group[order][1:] != group[order][:-1]))
        number = np.cumsum(same) - 1
        rows = np.bincount(number, weight[unit[left[order]]])
        stays = np.zeros(len(left), bool)
        stays[order] = rows[number] >= 2
        left, group = left[stays], group[stays]
        if not len(left):
            break
    repeated[left] = True
    return repeated


def covered(repeated: np.ndarray, depth: int) -> tuple[list[int], list[int]]:
    """The stretches of bytes that some repeated windows of a unit cover."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return [], []
    new = np.concatenate(([True], np.diff(at) > depth))
    last = np.concatenate((new[1:], [True]))
    return at[new].tolist(), (at[last] + depth).tolist()


def _sorted_units(depth: int):
    """Second pass: all unequal units of some grams, sorted by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def table() -> pa.RecordBatch:
            bodies = [r[6] for r in held]
            ends = np.cumsum([len(b) for b in bodies])
            data = np.frombuffer(b"".join(bodies), np.uint8)
            columns = [np.array([r[i] for r in held], np.int64) for i in (0, 1, 2, 5)]
            starts = ends - np.array([len(b) for b in bodies])
            repeated = repeated_windows(data, starts, *columns, depth)
            cuts = np.cumsum(columns[2])[:-1]
            spans = [covered(r, depth) for r in np.split(repeated, cuts)]
            rows = [(*r[:5], *s) for r, s in zip(held, spans, strict=True) if s[0]]
            return rows_out(SPANS, list(zip(*rows, strict=True)) if rows else [[]] * len(SPANS))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] == held[-1][:5]:
                    continue  # the example's text has another row with the same id
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield table()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield table()

    return run


def _hashed_windows(depth: int):
    """The windows of units whose gram has very many, each by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(key[2])
                hashes = [Rolling(data, base)(at, at + depth).view(np.int64) for base in (BYTE_BASE, WORD_BASE)]
                yield rows_out(HASHED, [*([k] * len(at) for k in key), at, *hashes])

    return run


def _units_spans(depth: int):
    """Windows that are repeated, gathered per unit, as stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                repeated = np.zeros(key[2], bool)
                repeated[places] = True
                rows.append((*key, *covered(repeated, depth)))
            if rows:
                yield rows_out(SPANS, list(zip(*rows, strict=True)))

    return run


def _without(with_text: bool):
    """Texts without the stretches to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, n, spans, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, kept, at, removed, runs = text.encode(), [], 0, 0, 0
                for span in sorted((s["from"], s["to"]) for s in spans):
                    if span[0] > at or not runs:
                        kept.append(body[at : span[0]])
                        runs += 1
                        at = span[0]
                    removed += max(0, span[1] - at)
                    at = max(at, span[1])
                kept = b"".join([*kept, body[at:]])
                rows.append((h, n, removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            if rows:
                yield rows_out(KEPT, list(zip(*rows, strict=True)))

    return run


def _asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of ``wanted`` (h, n, key): a table of slots keeps nearly all others from the shuffle."""
    slot = F.col("h").bitwiseXOR(F.col("key")).bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    slots = wanted.select(slot).distinct()
    own = docs.select("h", "n", F.coalesce("id", F.lit(NO_KEY)).alias("key"), "text").withColumn("slot", slot)
    return own.join(F.broadcast(slots), "slot", "left_semi").drop("slot")


def remove_repeated_windows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, *, depth: int = 400, with_text: bool = False
) -> DataFrame:
    """Each document without the bytes of strings of ``depth`` bytes that also start elsewhere.

    Gives the id, ``n_bytes``, ``n_removed``, ``n_spans`` (stretches removed), ``kept_sha256``, the column
    that ``row_col`` names, and with ``with_text`` the ``kept_text``: null if nothing was removed, and
    without the rest of a character that was cut.
    """
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(
        F.col(id_col).cast("long").alias("id"), row.alias("row"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n"), text.alias("text")
    )
    texts = written(docs.mapInArrow(_texts(depth), TEXTS_DDL), "window-texts")
    key = F.coalesce("least_id", F.lit(NO_KEY)).alias("key")
    units = texts.select("h", "n", key, F.size("ids").alias("copies"), F.explode(F.arrays_zip("start", *UNIT)).alias("unit"))
    units = units.select("h", "n", "key", "copies", *(F.col(f"unit.{c}").alias(c) for c in ("start", *UNIT)))

    # The first digit: grams that occur once, grams whose units are all equal, and the others.
    one_unit = F.struct(*UNIT)
    grams = units.groupBy("gram").agg(
        F.sum("copies").alias("total"), F.min(one_unit).alias("low"), F.max(one_unit).alias("high")
    ).where("total > 1")
    grams = written(grams.select("gram", (F.col("low") == F.col("high")).alias("settled")), "window-grams")
    found = written(units.join(grams, "gram"), "window-units")

    # The others' units, one example of each, with its bytes.
    place = F.min(F.struct("h", "n", "key", "start")).alias("place")
    kinds = found.where("not settled").groupBy(*UNIT).agg(F.sum("copies").alias("copies"), place)
    kinds = written(kinds.select(*UNIT, "copies", "place.*"), "window-kinds")
    piece = F.substring(F.encode("text", "UTF-8"), (F.col("start") + 1).cast("int"), (F.col("windows") + depth - 1).cast("int"))
    bodies = kinds.join(_asked(docs, kinds.select("h", "n", "key").distinct()), ["h", "n", "key"])
    bodies = bodies.select(*UNIT, "copies", piece.alias("body"))
    crowded = kinds.groupBy("gram").count().where(F.col("count") > MANY).select("gram")
    bodies = written(bodies, "window-bodies")
    few = bodies.join(crowded, "gram", "left_anti").repartition("gram").sortWithinPartitions(*UNIT)
    spans = few.mapInArrow(_sorted_units(depth), SPANS_DDL)
    many = bodies.join(crowded, "gram", "left_semi").dropDuplicates(UNIT)
    hashed = many.mapInArrow(_hashed_windows(depth), HASHED_DDL).join(many.select(*UNIT, "copies"), list(UNIT))
    same = ["gram", (F.col("offset") - F.col("at")).alias("away"), "w1", "w2"]
    hashed = hashed.select(*UNIT, "at", "copies", *same[1:])
    again = hashed.groupBy("gram", "away", "w1", "w2").agg(F.sum("copies").alias("total")).where("total > 1").drop("total")
    gathered = hashed.join(again, ["gram", "away", "w1", "w2"]).groupBy(*UNIT).agg(F.collect_list("at").alias("places"))
    spans = written(spans.unionByName(gathered.mapInArrow(_units_spans(depth), SPANS_DDL)), "window-spans")

    # Stretches of texts, and the texts without them.
    whole = found.where("settled").select(
        "h", "n", "key", F.col("start").alias("from"), (F.col("start") + F.col("windows") + F.lit(depth - 1)).alias("to")
    )
    part = found.where("not settled").join(spans, list(UNIT)).select("h", "n", "key", "start", F.explode(F.arrays_zip("froms", "tos")).alias("s"))
    part = part.select("h", "n", "key", (F.col("start") + F.col("s.froms")).alias("from"), (F.col("start") + F.col("s.tos")).alias("to"))
    least = texts.groupBy("h", "n").agg(F.min(key).alias("key"))
    stretches = whole.unionByName(part).drop("key").distinct().groupBy("h", "n").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    stretches = written(stretches.join(least, ["h", "n"]), "window-stretches")
    shorter = stretches.join(_asked(docs, stretches.select("h", "n", "key")), ["h", "n", "key"]).select("h", "n", "spans", "text").mapInArrow(
        _without(with_text), "h long, n long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
    shorter = written(shorter.dropDuplicates(["h", "n"]), "window-kept")
    members = texts.select("h", "n", "sha", F.explode(F.arrays_zip("ids", "rows")).alias("member")).join(shorter, ["h", "n"], "left")
    columns = [
        F.col("member.ids").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    ]
    if row_col:
        columns.append(F.col("member.rows").alias(row_col))
    if with_text:
        columns.append(F.col("kept").alias("kept_text"))
    return members.select(*columns)
