"""Near duplicates by an n-gram Jaccard join with rare-first prefixes.

1. Every text becomes its set of hashed word shingles. Texts with equal sets are one class from here on,
   and how often shingles occur is counted for 2^20 groups of them, each set once per task.
2. A set's shingles are ordered rare groups first; two sets that link must share one in the first
   fifth (the prefix). Prefix rows travel as packed arrays by shingle; shingles with one set drop out.
3. Sets that share a prefix shingle link to a leader of that shingle first. What is then in one component
   needs no further comparison, so a group of near copies takes one comparison each instead of all pairs.
4. The rest, pairs of different components, pass the length and positional filters, in blocks of bounded size.
Before whole sets are moved for a pair, the suffix filter compares summaries of theirs: sets are split at fixed pivots
into ranges of shingles, and two sets share at most the smaller number of each range. A summary takes a byte for one to two shingles.
Each pair that passes is verified once, on whole sets, whatever round proposes it again. The order of shingles only decides how much work
there is, never which links are found: two sets in one component are connected, all others are compared.

Shingles are 64-bit hashes, compared within one pair at a time; classes are told apart by 128 bits.

Defined cases: a null text is empty; a text without words has no shingles and links with nothing; one
with fewer words than a shingle has its whole sequence as its only shingle. Rows with equal ids are
different documents. An empty table gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cores, partitions_for, rows_out, steps, task_number, tidy, utf8, written
from .components import components
from .shingles import shingle_sets

# Groups of shingles whose frequency is counted: 4 MB, whatever the size of the corpus.
ORDER_BITS = 20
COUNT_CHUNK = 1 << 16
# Bytes of text that are hashed at once; NumPy holds some ten numbers for each byte.
STEP = 1 << 18
# Prefix rows of one partition, rows of a packed array, sets that a task folds at once.
PART_ROWS, PACK_ROWS, FOLD = 120_000, 100_000, 50_000
# Slots of the table that tells which sets are asked for: at most so many numbers reach the driver.
SLOTS = 1 << 22
# The same for the sets of some pairs: at most so many numbers are broadcast.
PAIR_SLOTS = 1 << 20
# Rows of a block in which sets of different components meet.
BLOCK = 1024
# Rows of blocks that are looked at together.
MEET_ROWS = 50_000
PARITY_BITS = 512

NODES = pa.schema(
    [
        ("node", pa.int64()),
        ("print", pa.binary()),
        ("sid", pa.int64()),
        ("n", pa.int64()),
        ("least_id", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("rows", pa.list_(pa.int64())),
        ("chunk", pa.int32()),
        ("counts", pa.binary()),
    ]
)
NODES_DDL = "node long, print binary, sid long, n long, least_id long, ids array<long>, rows array<long>, chunk int, counts binary"
PACKED = pa.schema([("part", pa.int32()), ("token", pa.binary()), ("sid", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])
PACKED_DDL = "part int, token binary, sid binary, n binary, pos binary"
LIVE = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
LIVE_DDL = "token long, sid long, n int, pos int"
SETS = pa.schema(
    [("sid", pa.int64()), ("key", pa.int64()), ("print", pa.binary()), ("hashes", pa.binary()), ("parity", pa.binary()), ("ranges", pa.binary())]
)
SETS_DDL = "sid long, key long, print binary, hashes binary, parity binary, ranges binary"
ENDS = [f"{c}_{end}" for end in "ab" for c in ("sid", "key", "print")]
ASKED_DDL = "a long, b long, sid_a long, key_a long, print_a binary, sid_b long, key_b long, print_b binary"
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "a long, b long"
NO_KEY = -(1 << 63)


def least_overlap(n: Column | np.ndarray | int, m, percent: int):
    """The least common shingles of linked sets of ``n`` and ``m``: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sid(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:8], "little", signed=True)


def parity(hashes: np.ndarray) -> bytes:
    """For each of 512 groups of shingles, whether the set has an odd number of them."""
    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def ranges(hashes: np.ndarray) -> bytes:
    """How many shingles lie in each of 2^k equal ranges, about one in each; nothing if a range has over 255."""
    bits = min(20, max(4, len(hashes).bit_length() - 1))
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(one: bytes, two: bytes) -> int | None:
    """How many shingles two sets can share by their ranges, None if that isn't known."""
    if not one or not two:
        return None
    x, y = np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(two, np.uint8).astype(np.int64)
    few = min(len(x), len(y))
    return int(np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum())


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in steps(batches, "text", STEP):
        yield batch, shingle_sets(*utf8(batch.column(batch.schema.get_field_index("text"))), width)


def _fold(width: int):
    """First pass: the classes of one task, and the task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        held: dict[bytes, list] = {}
        number = task_number() << 33

        def table() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for fingerprint, (n, ids, own) in held.items():
                least = min((i for i in ids if i is not None), default=None)
                rows.append((number, fingerprint, _sid(fingerprint), n, least, ids, own, None, None))
                number += 1
            return rows_out(NODES, list(zip(*rows, strict=True)) if rows else [[]] * len(NODES))

        for batch, sets in _sets(batches, width):
            fresh = []
            for key, row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                fingerprint = xxhash.xxh3_128_digest(own)
                entry = held.get(fingerprint)
                if entry is None:
                    entry = held[fingerprint] = [len(own), [], []]
                    fresh.append(own)
                entry[1].append(key)
                entry[2].append(row)
            if fresh:
                groups = (np.concatenate(fresh) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
                counts += np.bincount(groups, minlength=1 << ORDER_BITS)
            if len(held) > FOLD:
                yield table()
                held = {}
        yield table()
        few = np.minimum(counts, np.iinfo(np.uint32).max).astype("<u4")
        for chunk in range(0, len(few), COUNT_CHUNK):
            part = few[chunk : chunk + COUNT_CHUNK]
            if part.any():
                yield rows_out(NODES, [[None], [None], [None], [None], [None], [None], [None], [chunk // COUNT_CHUNK], [part.tobytes()]])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums.setdefault(chunk, np.zeros(COUNT_CHUNK, np.int64))[:] += np.frombuffer(counts, "<u4")
    for chunk, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])


def _ranks(nodes: DataFrame) -> np.ndarray:
    """The place of each group of shingles, rare ones first, in 20 bits: 4 MB."""
    chunks = nodes.where("chunk is not null").select("chunk", "counts").repartition((1 << ORDER_BITS) // COUNT_CHUNK, "chunk")
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for row in chunks.mapInArrow(tidy(_add_up), "chunk int, counts binary").collect():
        counts[row.chunk * COUNT_CHUNK : (row.chunk + 1) * COUNT_CHUNK] = np.frombuffer(row.counts, np.int64)
    ranks = np.empty(1 << ORDER_BITS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << ORDER_BITS, dtype=np.uint32)
    return ranks


def _ordered(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles as numbers that sort rare-first."""
    low = np.uint64((1 << (64 - ORDER_BITS)) - 1)
    return np.sort(ranks[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - ORDER_BITS) | hashes & low)


def _prefixes(width: int, percent: int, parts: int, shared):
    """Second pass: the prefix of each set, packed by the partition of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, set()
        tokens, sids, sizes, places, held = [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            token = np.concatenate(tokens)
            part = (token * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            columns = [x[order] for x in (token, np.concatenate(sids), np.concatenate(sizes), np.concatenate(places))]
            some = np.flatnonzero(edges[1:] > edges[:-1])
            return rows_out(PACKED, [some.tolist(), *([c[edges[p] : edges[p + 1]].tobytes() for p in some] for c in columns)])

        for _, sets in _sets(batches, width):
            for own in sets:
                n = len(own)
                if not n:
                    continue
                fingerprint = xxhash.xxh3_128_digest(own)
                if fingerprint in seen:
                    continue
                seen.add(fingerprint)
                sid = _sid(fingerprint)
                first = _ordered(own, ranks)[: prefix_length(n, percent)]
                tokens.append(first)
                sids.append(np.full(len(first), sid, np.int64))
                sizes.append(np.full(len(first), n, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                held += len(first)
            if held > PACK_ROWS:
                yield packed()
                tokens, sids, sizes, places, held = [], [], [], [], 0
            if len(seen) > 4 * FOLD:
                seen.clear()
        if held:
            yield packed()

    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that more than one set has. Kept is one row per shingle, however many sets have it."""
    token = np.zeros(0, np.uint64)
    sid, size, place, told = (np.zeros(0, k) for k in (np.int64, np.int32, np.int32, bool))
    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0

    def merge() -> pa.RecordBatch:
        nonlocal token, sid, size, place, told
        new = [np.concatenate([w[i] for w in waiting]) for i in range(4)]
        # The kept row of a shingle stands before its new ones.
        t, s, n, p = (np.concatenate((a, b)) for a, b in zip((token, sid, size, place), new, strict=True))
        was_told = np.concatenate((told, np.zeros(len(new[0]), bool)))
        kept_before = np.arange(len(t)) < len(token)
        order = np.argsort(t, kind="stable")
        t, s, n, p, was_told, kept_before = (x[order] for x in (t, s, n, p, was_told, kept_before))
        first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        other = s != s[at][group]
        several = np.zeros(len(at), bool)
        several[group[other]] = True
        tell = (other | (first & several[group])) & ~was_told & ~(kept_before & was_told)
        out = rows_out(LIVE, [t[tell].view(np.int64), s[tell], n[tell], p[tell]])
        token, sid, size, place, told = t[at], s[at], n[at], p[at], was_told[at] | several
        return out

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            waiting.append(tuple(np.frombuffer(x, k) for x, k in zip(row, (np.uint64, np.int64, np.int32, np.int32), strict=True)))
            held += len(waiting[-1][0])
            if held > PART_ROWS:
                yield merge()
                waiting, held = [], 0
    if waiting:
        yield merge()


def _asked_sets(width: int, shared):
    """Third pass: the sets that were asked for (and a few more, by the width of a slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        for batch, sets in _sets(batches, width):
            rows = []
            for key, own in zip(batch.column(0).to_pylist(), sets, strict=True):
                fingerprint = xxhash.xxh3_128_digest(own)
                sid, key = _sid(fingerprint), NO_KEY if key is None else key
                if len(own) and asked[(sid ^ key) & (SLOTS - 1)]:
                    rows.append((sid, key, fingerprint, own.tobytes(), parity(own), ranges(own)))
            if rows:
                yield rows_out(SETS, list(zip(*rows, strict=True)))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int((two[place] == one).sum())
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _suffix_filter(percent: int):
    """Pairs whose sets can share enough shingles by the ranges they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "ranges_a", "ranges_b"))
            most = [most_common(*pair) for pair in zip(x, y, strict=True)]
            may = [k is None or k >= least_overlap(p, q, percent) for k, p, q in zip(most, n, m, strict=True)]
            yield batch.filter(pa.array(may, pa.bool_())).select(["a", "b", *ENDS])

    return run


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _verify(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(the pairs that link, all pairs that were verified so far)``. Whole sets move only for pairs that pass the suffix filter and
    haven't been ``asked`` before."""

    def named(end: str) -> DataFrame:
        return known.select(F.col("cls").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("sid", "key", "print", "n", "ranges")))

    fresh = _ordered_pairs(pairs)
    if asked is not None:
        fresh = fresh.join(asked, ["a", "b"], "left_anti")
    new = written(fresh.join(named("a"), "a").join(named("b"), "b").mapInArrow(tidy(_suffix_filter(percent)), ASKED_DDL), "ngram-asked")

    def own(end: str, into: str) -> DataFrame:
        slots = new.select(F.col(f"sid_{end}").bitwiseAND(F.lit(PAIR_SLOTS - 1)).alias("slot")).distinct()
        some = sets.withColumn("slot", F.col("sid").bitwiseAND(F.lit(PAIR_SLOTS - 1))).join(F.broadcast(slots), "slot", "left_semi")
        return some.select(F.col("print").alias(f"print_{end}"), F.col("key").alias(f"key_{end}"), F.col("hashes").alias(into))

    whole = new.join(own("b", "two"), ["print_b", "key_b"]).join(own("a", "one"), ["print_a", "key_a"])
    links = written(whole.select("a", "b", "one", "two").mapInArrow(tidy(_verified(percent)), PAIRS_DDL).distinct(), "ngram-links")
    verified = new.select("a", "b")
    return links, verified if asked is None else asked.unionByName(verified)


def _may_link(n: Column, pos: Column, m: Column, place: Column, percent: int) -> Column:
    """Length and positional filter of two sets that share the shingle at these places of theirs."""
    lengths = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = F.least(n - pos, m - place)
    # Shingles before a shared one are shared at most, too.
    most = most + F.least(pos, place)
    return lengths & (most * (100 + percent) >= (n + m) * percent)


def _stars(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of each shingle's leader and its other sets that aren't connected to it yet."""
    pairs = met.where("label <> leader_label").where(
        _may_link(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos"), percent)
    )
    return pairs.select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()


def _with_leaders(live: DataFrame, by: Column) -> DataFrame:
    """The rows of shingles whose sets are in several components, with a leader for each shingle and its number of sets."""
    best = F.max(F.struct(by.alias("by"), "cls", "n", "pos", "label")).alias("best")
    ends = F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("sets")
    found = live.groupBy("token").agg(best, *ends).where("low <> high")
    names = {"cls": "leader", "n": "leader_n", "pos": "leader_pos", "label": "leader_label"}
    leaders = found.select("token", "sets", *(F.col(f"best.{k}").alias(v) for k, v in names.items()))
    return live.select("token", "cls", "n", "pos", "label").join(leaders, "token")


def _labelled(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the component of their set, without shingles whose sets are all connected."""
    if labels is None:
        return live.withColumn("label", F.col("cls"))
    rows = live.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("sets"))
    return rows.join(mixed.where("low <> high").select("token", "sets"), "token")


def _rest(percent: int):
    """Pairs within blocks (rows come block by block) that pass all filters and aren't connected."""

    def meet(table: pa.Table) -> pa.RecordBatch:
        token, i, j, half, cls, n, pos, label = (table.column(c).to_numpy() for c in ("token", "i", "j", "half", "cls", "n", "pos", "label"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(cls), -1)
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        ends = np.append(np.flatnonzero(new)[1:], len(cls))[np.cumsum(new) - 1]
        x, found = np.arange(len(cls)), []
        for ahead in range(1, len(cls)):
            # Each row meets the one so far ahead of it in its block.
            x = x[x + ahead < ends[x]]
            if not len(x):
                break
            y = x + ahead
            ok = (label[x] != label[y]) & ((i[x] == j[x]) | (half[x] != half[y]))
            ok &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            most = np.minimum(n[x] - pos[x], n[y] - pos[y]) + np.minimum(pos[x], pos[y])
            ok &= most * (100 + percent) >= (n[x] + n[y]) * percent
            a, b = x[ok], y[ok]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1).astype(np.int64)
            ok = n[a] + n[b] - differ >= 2 * least_overlap(n[a], n[b], percent)
            found.append(np.stack((np.minimum(cls[a[ok]], cls[b[ok]]), np.maximum(cls[a[ok]], cls[b[ok]])), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return rows_out(PAIRS, [pairs[:, 0], pairs[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < MEET_ROWS:
                continue
            table = pa.Table.from_batches(held)
            # The last block may go on.
            key = [table.column(c).to_numpy() for c in ("token", "i", "j")]
            last = np.logical_and.reduce([k == k[-1] for k in key])
            cut = int(np.argmax(last))
            if cut:
                yield meet(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield meet(pa.Table.from_batches(held))

    return run


def _blocks(live: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle and pass the filters."""
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    rows = live.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "token",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.col("own").alias("half"),
        "cls",
        F.col("n").cast("long").alias("n"),
        F.col("pos").cast("long").alias("pos"),
        "label",
        "parity",
    )
    together = met.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "cls")
    return together.mapInArrow(tidy(_rest(percent)), PAIRS_DDL).distinct()


def ngram_jaccard_join(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    *,
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Near-duplicate groups: one row per input row with its id, ``n_shingles`` and ``component_id``.

    Two documents link if their sets' Jaccard similarity is ``percent`` or more; ``component_id`` is the
    smallest id that links lead to. If ``row_col`` names a column of row numbers, the result has it, and
    ``component_row``, the smallest one among the rows with the smallest id.
    """
    spark = df.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    docs = df.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    nodes = written(docs.mapInArrow(tidy(_fold(width)), NODES_DDL), "ngram-nodes")
    classes = nodes.where("n > 0").groupBy("print").agg(
        F.min("node").alias("cls"), F.first("sid").alias("sid"), F.first("n").alias("n"), F.min("least_id").alias("rep")
    )
    # The row whose text stands for the class, by its set and id.
    classes = written(classes.withColumn("key", F.coalesce("rep", F.lit(NO_KEY))), "ngram-classes")
    total = classes.agg(F.sum("n")).first()[0]
    parts = partitions_for((total or 0) * (100 - percent) // 100, PART_ROWS, cores(df))

    ranks = spark.sparkContext.broadcast(_ranks(nodes))
    packed = docs.select("id", "text").mapInArrow(tidy(_prefixes(width, percent, parts, ranks)), PACKED_DDL)
    found = packed.repartition(parts, "part").mapInArrow(tidy(_shared_tokens), LIVE_DDL)
    found = found.groupBy("token", "sid").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    live = written(found.join(classes.select("sid", "cls", "key"), "sid"), "ngram-live")

    slots = np.zeros(SLOTS, bool)
    taken = live.select(F.col("sid").bitwiseXOR(F.col("key")).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct()
    slots[taken.toArrow().column(0).to_numpy()] = True
    asked_slots = spark.sparkContext.broadcast(np.packbits(slots).tobytes())
    sets = written(docs.select("id", "text").mapInArrow(tidy(_asked_sets(width, asked_slots)), SETS_DDL), "ngram-sets")
    live = live.select("token", "cls", "n", "pos")

    # First the set with most shared shingles in its prefix leads: edits put rare ones of their own there.
    # Then the one with most links so far.
    shared = live.groupBy("cls").agg(F.count(F.lit(1)).alias("shared"))
    # What is known of the set that stands for a class, but for its shingles.
    of_class = classes.select("cls", "print", "key", "n").join(sets.drop("hashes"), ["print", "key"]).dropDuplicates(["cls"])
    known = written(of_class, "ngram-known")
    first = written(_labelled(live, None).join(shared, "cls"), "ngram-first")
    met = written(_with_leaders(first, F.col("shared")), "ngram-met")
    edges, asked = _verify(_stars(met, percent), known, sets, percent)
    labels = components(edges)
    # A shingle of two sets has no pair but theirs, which was looked at.
    live = met.where("sets > 2").select("token", "cls", "n", "pos")
    degree = edges.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    second = written(_labelled(live, labels).join(degree, "cls", "left"), "ngram-mixed")
    more, asked = _verify(_stars(_with_leaders(second, F.coalesce("degree", F.lit(0))), percent), known, sets, percent, asked)
    edges = edges.unionByName(more)
    labels = components(edges)
    mixed = written(_labelled(live, labels), "ngram-mixed")
    rest = written(_blocks(mixed.join(known.select("cls", "parity"), "cls"), percent), "ngram-pairs")
    last, _ = _verify(rest, known, sets, percent, asked)
    edges = edges.unionByName(last)
    labels = components(edges)

    grouped = classes.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left")
    grouped = grouped.select("print", "rep", F.coalesce("label", "cls").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = grouped.join(smallest, "label").select("print", "label", "component_id")
    members = nodes.where("chunk is null").join(known, "print", "left").select(
        "n", "label", "component_id", F.explode(F.arrays_zip("ids", "rows")).alias("member")
    )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("member.ids"))
    columns = [F.col("member.ids").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")]
    if not row_col:
        return members.select(*columns)
    own = F.when(F.col("member.ids").eqNullSafe(component), F.col("member.rows"))
    rows = members.select(*columns, F.col("member.rows").alias(row_col), "label", own.alias("own"))
    firsts = rows.where("label is not null").groupBy("label").agg(F.min("own").alias("component_row"))
    joined = rows.join(firsts, "label", "left")
    return joined.select(id_col, "n_shingles", "component_id", row_col, F.coalesce("component_row", F.col(row_col)).alias("component_row"))
