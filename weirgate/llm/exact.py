"""Exact duplicates by Patricia tries.

Every task first puts its own texts into a compressed radix trie, so that copies inside a task become
one *node* (a row with the ids of its documents). Nodes are dealt out by length and content hash, and
each partition inserts their full byte strings into a trie whose terminals keep the smallest owner.
A trie that outgrows its memory gives up whole subtrees: in the first pass they are handed on as they
are, in the second they go to the next round, which deals them to more partitions. Only one row per
text and task is ever shuffled with its bytes, so a text with a third of all copies is as cheap as
any other.

Defined cases: a null text is an empty text; all empty or blank texts are one group. Null ids come
after all others. Rows with equal id and text are different rows of one group, of which one is kept.
An empty table gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cores, partitions_for, task_number, tidy, written

# The characters that do not count: space and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
# Python's own memory for a trie node, next to its bytes.
NODE_BYTES = 300

NODES = pa.schema(
    [
        ("node", pa.int64()),
        ("n_bytes", pa.int64()),
        ("digest", pa.binary()),
        ("body", pa.binary()),
        ("chars", pa.int64()),
        ("best_id", pa.int64()),
        ("best_at", pa.int32()),
        ("copies", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("rows", pa.list_(pa.int64())),
    ]
)
NODES_DDL = (
    "node long, n_bytes long, digest binary, body binary, chars long, best_id long, best_at int, copies long,"
    " ids array<long>, rows array<long>"
)
OWNERS = pa.schema(
    [
        ("node", pa.int64()),
        ("owner", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
        ("n_bytes", pa.int64()),
        ("hash", pa.int64()),
        ("body", pa.binary()),
        ("chars", pa.int64()),
        ("copies", pa.int64()),
    ]
)
OWNERS_DDL = (
    "node long, owner long, keep_id long, group_size long, n_bytes long, hash long, body binary, chars long, copies long"
)


class _Node:
    """The bytes on the way in, the ways on by their first byte, and what ends here."""

    __slots__ = ("label", "ways", "entry", "closed")

    def __init__(self, label: bytes) -> None:
        self.label, self.ways, self.entry, self.closed = label, {}, None, False


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` on have in common."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Patricia:
    """A compressed radix trie over byte strings; ``size`` counts the bytes it holds."""

    def __init__(self) -> None:
        self.root, self.size = _Node(b""), 0

    def find(self, key: bytes) -> _Node | None:
        """The terminal of ``key``, made if it is new; None in a subtree that was given up."""
        node, at = self.root, 0
        while at < len(key):
            way = node.ways.get(key[at])
            if way is None:
                way = node.ways[key[at]] = _Node(key[at:])
                self.size += len(way.label) + NODE_BYTES
                return way
            if way.closed:
                # A given-up subtree takes all that begins with its first byte.
                return None
            if key.startswith(way.label, at):
                node, at = way, at + len(way.label)
                continue
            cut = _shared(way.label, key, at)
            fork = _Node(way.label[:cut])
            way.label = way.label[cut:]
            fork.ways[way.label[0]] = way
            node.ways[key[at]] = fork
            self.size += NODE_BYTES
            node, at = fork, at + cut
        return node

    def heaviest(self) -> _Node | None:
        """The subtree to give up: the heaviest way out of the first fork that has several open ones."""
        node = self.root
        while True:
            ways = [w for w in node.ways.values() if not w.closed]
            if len(ways) == 1 and node.entry is None and ways[0].ways:
                node = ways[0]
                continue
            if len(ways) + (node.entry is not None) < 2:
                return None
            return max(ways, key=weight)

    def give_up(self, node: _Node, close: bool) -> list:
        """The entries below ``node``, which the trie then no longer holds."""
        self.size -= weight(node)
        entries = [x.entry for x in below(node) if x.entry is not None]
        node.ways, node.entry = {}, None
        node.closed = close
        return entries

    def entries(self) -> Iterator[object]:
        return (x.entry for x in below(self.root) if x.entry is not None)


def below(node: _Node) -> Iterator[_Node]:
    waiting = [node]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(node.ways.values())


def weight(node: _Node) -> int:
    return sum(len(x.label) + NODE_BYTES for x in below(node))


def _order(chars: int, key: int | None) -> tuple:
    """The row that stays comes first: most code points, then the smallest id, null last."""
    return (-chars, key is None, key or 0)


def _own_nodes(memory: int):
    """First pass: the texts of one task, copies folded."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, number = Patricia(), task_number() << 33

        def table(entries) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, held = [], 0
            for body, chars, best, at, ids, own in entries:
                rows.append((number, len(body), hashlib.sha256(body).digest(), body, chars, best, at, len(ids), ids, own))
                number += 1
                held += len(body)
                if held > 4 << 20:
                    yield _rows(NODES, rows)
                    rows, held = [], 0
            if rows:
                yield _rows(NODES, rows)

        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            bodies = batch.column(2).cast(pa.binary()).to_pylist()
            for key, row, body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, chars, strict=True):
                body = (body or b"").translate(None, BLANKS)
                place = trie.find(body)
                entry = place.entry
                if entry is None:
                    place.entry = [body, n, key, 0, [key], [row]]
                    trie.size += len(body)
                else:
                    if _order(n, key) < _order(entry[1], entry[2]):
                        entry[1:4] = n, key, len(entry[4])
                    entry[4].append(key)
                    entry[5].append(row)
                    trie.size += 16
                if trie.size > memory:
                    subtree = trie.heaviest()
                    if subtree is None:
                        yield from table(trie.entries())
                        trie = Patricia()
                    else:
                        held = sum(len(x.entry[0]) + 16 * len(x.entry[4]) for x in below(subtree) if x.entry is not None)
                        yield from table(trie.give_up(subtree, close=False))
                        trie.size -= held
        yield from table(trie.entries())

    return fold


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )


def _owners(memory: int):
    """Second pass: all nodes of a text meet in one trie; the best of them owns the text."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        for batch in batches:
            later = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node, n_bytes, content, body, chars, best, copies = row
                place = trie.find(body)
                if place is None:
                    later.append((node, None, best, None, n_bytes, content, body, chars, copies))
                    continue
                if place.entry is None:
                    place.entry = [[], n_bytes, content, body]
                    trie.size += len(body)
                place.entry[0].append((node, chars, best, copies))
                trie.size += 100
                if trie.size > memory and (subtree := trie.heaviest()) is not None:
                    for nodes, size, code, text in trie.give_up(subtree, close=True):
                        trie.size -= 100 * len(nodes) + len(text)
                        later += [(n, None, b, None, size, code, text, c, k) for n, c, b, k in nodes]
            if later:
                yield _rows(OWNERS, later)
        done = []
        for nodes, *_ in trie.entries():
            owner, _, keep, _ = min(nodes, key=lambda x: (*_order(x[1], x[2]), x[0]))
            size = sum(x[3] for x in nodes)
            done += [(x[0], owner, keep, size, None, None, None, None, None) for x in nodes]
            if len(done) > 20_000:
                yield _rows(OWNERS, done)
                done = []
        if done:
            yield _rows(OWNERS, done)

    return own


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    *,
    trie_bytes: int = 64 << 20,
    share_bytes: int = 24 << 20,
) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal if they are without blanks. Gives one row per input row: the id, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` and, if ``row_col`` names a column, that column.
    ``trie_bytes`` bounds the memory of a trie, ``share_bytes`` the text of a partition.
    """
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    nodes = written(rows.mapInArrow(tidy(_own_nodes(trie_bytes)), NODES_DDL), "exact-nodes")
    total = nodes.agg(F.sum("n_bytes")).first()[0]
    share = partitions_for(total, share_bytes, cores(df))
    left = nodes.select(
        "node",
        "n_bytes",
        F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("hash"),
        "body",
        "chars",
        F.col("best_id").alias("keep_id"),
        "copies",
    )
    owners = None
    while True:
        judged = written(
            left.repartition(share, "n_bytes", "hash").mapInArrow(tidy(_owners(trie_bytes)), OWNERS_DDL), "exact-owners"
        )
        done = judged.where(F.col("owner").isNotNull()).select("node", "owner", "keep_id", "group_size")
        owners = done if owners is None else owners.unionByName(done)
        left = judged.where(F.col("owner").isNull()).select("node", "n_bytes", "hash", "body", "chars", "keep_id", "copies")
        if left.isEmpty():
            break
        share *= 8
    members = nodes.select("node", "digest", "best_at", F.posexplode(F.arrays_zip("ids", "rows")).alias("at", "member"))
    columns = [
        F.col("member.ids").alias(id_col),
        F.col("keep_id"),
        F.col("group_size"),
        ((F.col("node") == F.col("owner")) & (F.col("at") == F.col("best_at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    if row_col:
        columns.append(F.col("member.rows").alias(row_col))
    return members.join(owners, "node").select(*columns)
