"""Packing of documents into sequences by best fit and swap-based local search.

Documents are encoded where they are read and only their lengths are shuffled, dealt by hash into
groups of bounded size. A group is packed best-fit, largest first; then the emptiest bins give their
documents away: by a move into a gap, or by exchanging one document, or any two, for a smaller one of a
fuller bin. Every step makes the sum of squared fills larger, so the search ends, and it does so when no bin has a step left.
The lengths in a bin are the bits of a number, and so are the sums of its pairs, so whether two bins have an exchange that closes a gap by
so much is one shift. Bins that become empty are gone. A document longer than a sequence is cut into full pieces behind a shorter first one.

Defined cases: a null text is an empty document, of its end id alone. Rows with equal ids are
different documents. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out, steps, task_number, tidy, written
from .tokens import text_encoder

# Pieces that are packed together; what a group leaves open is one sequence or two of its thousand.
GROUP = 4096
# Bytes of text whose words are looked up together.
STEP_BYTES = 1 << 22

PIECES = pa.schema(
    [
        ("key", pa.int64()),
        ("id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("crc", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = "key long, id long, piece int, start long, length long, crc long, ids binary"
PLACED = pa.schema(
    [
        ("id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("crc", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PLACED_DDL = "id long, piece int, start long, length long, crc long, sequence_id long, offset long, ids binary"


class Bins:
    """Bins of one size, each a sorted list of (length, item)."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.gap = size, [], []
        # The lengths in each bin as bits.
        self.lengths: list[int] = []
        # Bins by their gap, and a bit for each gap that some bin has.
        self.by_gap: list[set[int]] = [set() for _ in range(size + 1)]
        self.some = 0

    def _set_gap(self, at: int, gap: int) -> None:
        old = self.gap[at]
        self.by_gap[old].discard(at)
        if not self.by_gap[old]:
            self.some &= ~(1 << old)
        self.gap[at] = gap
        self.by_gap[gap].add(at)
        self.some |= 1 << gap

    def best_fit(self, length: int, but: int = -1) -> int:
        """The bin with the smallest gap that takes ``length``, -1 if none does."""
        open_gaps = self.some >> length
        while open_gaps:
            gap = length + (open_gaps & -open_gaps).bit_length() - 1
            for at in self.by_gap[gap]:
                if at != but and self.held[at]:
                    return at
            open_gaps &= open_gaps - 1
            if gap >= self.size:
                break
        return -1

    def put(self, at: int, item: tuple[int, int]) -> None:
        insort(self.held[at], item)
        self.lengths[at] |= 1 << item[0]
        self._set_gap(at, self.gap[at] - item[0])

    def take(self, at: int, item: tuple[int, int]) -> None:
        own = self.held[at]
        own.pop(bisect_left(own, item))
        if not self._with(at, item[0]):
            self.lengths[at] &= ~(1 << item[0])
        self._set_gap(at, self.gap[at] + item[0])

    def _with(self, at: int, length: int) -> list[tuple[int, int]]:
        """The first two documents of a length in a bin."""
        own = self.held[at]
        i = bisect_left(own, (length, -1))
        return [x for x in own[i : i + 2] if x[0] == length]

    def open(self) -> int:
        self.held.append([])
        self.lengths.append(0)
        self.gap.append(self.size)
        self.by_gap[self.size].add(len(self.gap) - 1)
        self.some |= 1 << self.size
        return len(self.gap) - 1

    def fill(self, lengths: list[int]) -> None:
        for item in sorted(((n, i) for i, n in enumerate(lengths)), reverse=True):
            at = self.best_fit(item[0])
            self.put(self.open() if at < 0 else at, item)

    def _fuller(self, than: int) -> list[int]:
        """Bins with room that are fuller than one, those with most room first."""
        gaps, found = self.some & ((1 << self.gap[than]) - 1) & ~1, []
        while gaps:
            gap = gaps.bit_length() - 1
            found += sorted(self.by_gap[gap])
            gaps &= ~(1 << gap)
        return found

    def _sums(self, at: int) -> int:
        """The lengths of single documents and of pairs of a bin as bits."""
        single = sums = self.lengths[at]
        rest = single
        while rest:
            length = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            # With longer ones, and with another of this length.
            sums |= rest << length
            if len(self._with(at, length)) > 1:
                sums |= 1 << 2 * length
        return sums

    def _given(self, at: int, total: int) -> list[tuple[int, int]]:
        """One document of a bin with this length, else two."""
        if one := self._with(at, total):
            return one[:1]
        for item in self.held[at]:
            pair = self._with(at, total - item[0])
            if pair and (pair[0] != item or len(pair) > 1):
                return [item, pair[pair[0] == item]]
        raise LookupError(total)

    def _improve(self, at: int, since: int) -> int:
        """One step that takes tokens out of bin ``at`` and into a fuller one that was changed after ``since``: that bin, else -1."""
        for item in reversed(self.held[at]):
            to = self.best_fit(item[0], at)
            if to >= 0 and self.gap[to] <= self.gap[at]:
                self.take(at, item)
                self.put(to, item)
                return to
        sums = self._sums(at)
        for to in self._fuller(at):
            if self.changed[to] <= since:
                continue
            theirs = self.lengths[to]
            # The exchange that closes most of the gap.
            for more in range(self.gap[to], 0, -1):
                if both := (sums >> more) & theirs:
                    length = (both & -both).bit_length() - 1
                    out, back = self._given(at, length + more), self._with(to, length)[0]
                    for x in out:
                        self.take(at, x)
                    self.take(to, back)
                    for x in out:
                        self.put(to, x)
                    self.put(at, back)
                    return to
        return -1

    def search(self) -> None:
        """Empties bins, emptiest first, until no step is left that makes a fuller bin fuller."""
        # When each bin was last changed, and looked at without finding a step. A bin that hasn't changed since only looks at those that have.
        self.changed, looked, clock, steps = [1] * len(self.held), [0] * len(self.held), 1, 1
        while steps:
            steps = 0
            least = [at for at, held in enumerate(self.held) if held and self.gap[at]]
            for at in sorted(least, key=lambda x: (-self.gap[x], x)):
                since = looked[at] if self.changed[at] <= looked[at] else 0
                while self.held[at] and self.gap[at] and (to := self._improve(at, since)) >= 0:
                    clock, steps, since = clock + 1, steps + 1, 0
                    self.changed[at] = self.changed[to] = clock
                looked[at] = clock


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """The items of each bin, in the order in which they lie there."""
    bins = Bins(size)
    bins.fill(lengths)
    bins.search()
    return [[i for _, i in reversed(held)] for held in bins.held if held]


def token_pieces(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``size`` ids, with a key that is the piece's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(path, pattern), end_id.to_bytes(4, "little")
        key = task_number() << 33
        for batch in steps(batches, "text", STEP_BYTES):
            rows = []
            ids, counts = encoder.many(batch.column(1))
            ids, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            for doc, first, last in zip(batch.column(0).to_pylist(), [0, *ends], ends, strict=False):
                own = ids[first:last] + end
                n = len(own) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = own[4 * a : 4 * b]
                    rows.append((key, doc, piece, a, b - a, zlib.crc32(part), part if with_ids else None))
                    key += 1
            yield rows_out(PIECES, list(zip(*rows, strict=True)) if rows else [[]] * len(PIECES))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), PIECES_DDL)


def pack_documents(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = 1024,
    end_id: int = 2,
    group: int = GROUP,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids`` if asked for."""
    pieces = written(
        token_pieces(df, path, pattern, id_col, text_col, size=size, end_id=end_id, with_ids=with_ids), "pack-pieces"
    )
    groups = max(1, -(-pieces.count() // group))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # Pieces arrive in any order; sorted by their key, a repeated task packs them as before.
        table = table.sort_by("key")
        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, items in enumerate(pack_lengths(lengths, size)):
            at = 0
            for i in items:
                sequence[i], offset[i] = key[0].as_py() << 32 | number, at
                at += lengths[i]
        columns = {n: table.column(n).combine_chunks() for n in table.column_names}
        columns |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
        return pa.Table.from_arrays([columns[f.name] for f in PLACED], schema=PLACED)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    placed = dealt.groupBy("group").applyInArrow(pack, PLACED_DDL)
    columns = [F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if with_ids else []))
