"""Token-id files, compressed by a Re-Pair grammar per shard.

Documents are dealt out by ranges of their id (and text, so that an id with many rows is spread), sorted, encoded and written as shards. In a shard the
most frequent pairs of neighbouring symbols become nonterminals, a few thousand pairs at a time, until
no pair is frequent or 16-bit symbols run out. A shard file holds the rules, the length of what each
nonterminal stands for, the symbols, and each document's id and length; with the lengths any document
can be decoded without the ones before it. Spark writes the files, so a lost executor costs one task.

File format, little-endian: ``WGRP``; five unsigned 32-bit numbers: first nonterminal, rules,
symbols, documents, bytes per symbol; the rules' two sides; the rules' expansion lengths (32 bits
each); the symbols; the documents' ids (64 bits), a byte for each that is null, their lengths (32 bits).

Defined cases: a null text is an empty document, of its end id alone; null ids come first; rows with
equal ids are different documents, in any order among themselves. An empty table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_out, steps, task_number
from .tokens import blank_encoder

MAGIC = b"WGRP"
# Symbols are 16-bit as long as the vocabulary leaves room for rules there.
NARROW = 1 << 16
# Ids of a shard, pairs replaced in one round, and the occurrences that a pair must have.
SHARD_IDS, ROUND_PAIRS, LEAST = 2_000_000, 8192, 16
# Places of the table in which a round looks its pairs up.
TABLE_BITS = 20
# Bytes of text whose words are looked up together.
STEP_BYTES = 1 << 22

FILES = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])
FILES_DDL = "shard long, n_docs long, n_tokens long, file binary"
DOCS = pa.schema(
    [("shard", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())]
)
DOCS_DDL = "shard long, id long, start long, n_tokens long, crc long, ids binary"


def re_pair(ids: np.ndarray, first: int, barrier: int, least: int = LEAST, pairs: int = ROUND_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of ``ids`` and the rules, row ``i`` being what ``first + i`` stands for.

    ``barrier`` (the end id) is in no pair, so no rule reaches across two documents.
    """
    most = (NARROW if first < NARROW - 256 else 1 << 31) - first
    # A pair is one number of twice the symbols' width.
    kind, bits = (np.uint32, 16) if most <= NARROW else (np.uint64, 32)
    symbols, rules = ids.astype(kind), np.zeros((0, 2), kind)
    while len(symbols) > 1 and len(rules) < most:
        key = symbols[:-1] << kind(bits) | symbols[1:]
        free = symbols != barrier
        open_pairs = free[:-1] & free[1:]
        ordered = np.sort(key[open_pairs])
        if not len(ordered):
            break
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(edges, len(ordered)))
        frequent = np.flatnonzero(counts >= least)
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")[: min(pairs, most - len(rules))]]
        chosen = ordered[edges[frequent]]
        # Of pairs that share a place of the table, the most frequent one is replaced in this round.
        _, firsts = np.unique(_place(chosen), return_index=True)
        chosen = chosen[np.sort(firsts)]
        if not len(chosen):
            break
        table = np.zeros(1 << TABLE_BITS, np.int32)
        table[_place(chosen)] = np.arange(1, len(chosen) + 1)
        rule = table[_place(key)]
        at = np.flatnonzero((rule > 0) & open_pairs)
        rule = rule[at] - 1
        same = chosen[rule] == key[at]
        at, rule = at[same], rule[same]
        # Of pairs that overlap, every other one from the left is replaced.
        run = np.concatenate(([True], np.diff(at) != 1))
        first_of_run = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - first_of_run) % 2 == 0
        at, rule = at[taken], rule[taken]
        symbols[at] = (first + len(rules) + rule).astype(kind)
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols = symbols[left]
        rules = np.concatenate((rules, np.stack((chosen >> kind(bits), chosen & kind((1 << bits) - 1)), axis=1)))
    return symbols.astype(np.uint32), rules.astype(np.uint32)


def _place(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule only names symbols made before it."""
    lengths = np.ones(len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    return lengths


def write_shard(ids: np.ndarray, docs: list[int | None], lengths: list[int], first: int, barrier: int) -> bytes:
    symbols, rules = re_pair(ids, first, barrier)
    width = 2 if first + len(rules) <= NARROW else 4
    return b"".join(
        (
            MAGIC,
            struct.pack("<5I", first, len(rules), len(symbols), len(docs), width),
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, first).astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            bytes(d is None for d in docs),
            np.array(lengths, "<u4").tobytes(),
        )
    )


class Shard:
    """A shard file, decoded on demand."""

    def __init__(self, file: bytes) -> None:
        if file[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.first, n_rules, n_symbols, n_docs, width = struct.unpack_from("<5I", file, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(file, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.expansions = take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)
        self.docs = take("<i8", n_docs)
        self.null = take("u1", n_docs)
        self.lengths = take("<u4", n_docs)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))
        self._ends: np.ndarray | None = None

        # What every symbol stands for, one after the other; a rule only names symbols made before it.
        own = [(i,) for i in range(self.first)]
        for a, b in self.rules.tolist():
            own.append(own[a] + own[b])
        self._wide = np.array([len(x) for x in own], np.int64)
        self._from = np.cumsum(self._wide) - self._wide
        self._flat = np.fromiter((i for x in own for i in x), "<u4", int(self._wide.sum()))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        wide = self._wide[symbols]
        ends = np.cumsum(wide)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.arange(total) + np.repeat(self._from[symbols] - ends + wide, wide)]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, by its place in the shard; only its own symbols are expanded."""
        if self._ends is None:
            wide = np.ones(len(self.symbols), np.int64)
            inner = self.symbols >= self.first
            wide[inner] = self.expansions[self.symbols[inner].astype(np.int64) - self.first]
            self._ends = np.cumsum(wide)
        a, b = np.searchsorted(self._ends, self.starts[i : i + 2], "right")
        return self._expand(self.symbols[a : b + 1])[: self.lengths[i]] if self.lengths[i] else np.zeros(0, "<u4")


def write_token_files(
    df: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, vocabulary: int = 49_408
) -> None:
    """Writes the documents, in the order of their ids, as shard files in a new folder ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = blank_encoder(path), end_id.to_bytes(4, "little")
        number = task_number() << 20
        docs, parts, held = [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in parts]
            file = write_shard(np.frombuffer(b"".join(parts), "<u4"), docs, lengths, vocabulary, end_id)
            return rows_out(FILES, [[number], [len(docs)], [sum(lengths)], [file]])

        for batch in steps(batches, "text", STEP_BYTES):
            ids, counts = encode.many(batch.column(1))
            ids, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends, strict=False):
                docs.append(doc)
                parts.append(ids[a:b] + end)
                held += len(parts[-1]) // 4
                if held >= SHARD_IDS:
                    yield shard()
                    number, docs, parts, held = number + 1, [], [], 0
        if docs:
            yield shard()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FILES_DDL).write.parquet(out)


def read_token_files(spark: SparkSession, out: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document: id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` (32-bit, little-endian)."""
    files = spark.read.schema(FILES_DDL).parquet(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(file)
                ids = memoryview(shard.all_ids()).cast("B")
                own = [ids[4 * a : 4 * b] for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
                yield rows_out(
                    DOCS,
                    [
                        [number] * len(own),
                        [None if gone else d for d, gone in zip(shard.docs.tolist(), shard.null, strict=True)],
                        shard.starts[:-1],
                        shard.lengths.astype(np.int64),
                        [zlib.crc32(x) for x in own],
                        [bytes(x) if with_ids else None for x in own],
                    ],
                )

    # Ids before a shard: those of earlier tasks, a number per task, and those before it in its own.
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = files.select("shard", F.shiftright("shard", 20).alias("task"), "n_tokens")
    tasks = own.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens")).select("task", earlier(Window.orderBy("task")).alias("of_tasks"))
    inside = own.select("task", "shard", earlier(Window.partitionBy("task").orderBy("shard")).alias("inside"))
    starts = inside.join(tasks, "task").select("shard", (F.col("of_tasks") + F.col("inside")).alias("before"))
    docs = files.select("shard", "file").mapInArrow(run, DOCS_DDL).join(starts, "shard")
    columns = ["id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")]
    return docs.select(*columns, *(["ids"] if with_ids else []))
