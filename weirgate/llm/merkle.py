"""A Merkle manifest of a table: a hash tree per group of rows, and one over the groups' roots.

Every inner node is the hash of up to three children. A tree is cut into blocks: complete subtrees of
``HEIGHT`` levels below their root, aligned at multiples of 3^HEIGHT leaves. The roots of a tier of blocks are the
leaves of the next one, so each tier is one grouped job over blocks of bounded size, whatever the size of
a group, and the number of tiers grows with the logarithm of the rows.

The nodes of a block lie in van Emde Boas order: a subtree is its upper half followed by its lower
subtrees, each laid out by the same rule. ``address`` finds a node's place by arithmetic alone; building
and looking up siblings both use it.

1. Leaves are hashed in generated code and sorted by range. A row's place in its group is its place in its
   run plus one number per partition (the rows of the same group in earlier partitions).
2. Tiers of blocks are built bottom-up and written to the manifest.
3. Proofs go top-down: a block gets the siblings on the way from its root to the tree's root, and adds those inside of it.

Defined cases: a null field is written ``-``, so it differs from an empty one. Null ids come first in their
group, equal ids by leaf; equal leaves are alike. An empty table gives no blocks and no proofs. Very long texts
are hashed where they are and not moved. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cores, once, partitions_for, rows_out, task_number, with_rows, written

FANOUT = 3
# Levels of a block below its root: 729 leaves and 1,093 nodes.
HEIGHT = 6
WIDTH = FANOUT**HEIGHT
# Rows of a sorted partition.
PART_ROWS = 1_000_000
DIGEST = 32

BLOCKS = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("height", pa.int32()), ("n", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())]
)
BLOCKS_DDL = "tree string, block long, height int, n int, nodes binary, root binary"
LEAVES_DDL = "tree string, pos long, id long, leaf binary, carried binary"
PATHS = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("shape", pa.binary()), ("siblings", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]
)
PATHS_DDL = "tree string, block long, shape binary, siblings binary, subroot binary, root binary"
PROOFS = pa.schema(
    [("tree", pa.string()), ("id", pa.int64()), ("leaf", pa.binary()), ("carried", pa.binary())] + [PATHS.field(i) for i in range(2, 6)]
)
PROOFS_DDL = "tree string, id long, leaf binary, carried binary, shape binary, siblings binary, subroot binary, root binary"


def nodes_of(height: int) -> int:
    """Nodes of a complete tree with so many levels below its root."""
    return (FANOUT ** (height + 1) - 1) // (FANOUT - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where nodes of one depth lie in the layout of a tree of this height, by their numbers in that depth."""
    at, levels = np.zeros(len(index), np.int64), height + 1
    index = np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        # The lower subtree that holds the node, behind the upper half and the lower ones before it.
        depth, lower = depth - upper, levels - upper
        own, index = np.divmod(index, FANOUT**depth)
        at += nodes_of(upper - 1) + own * nodes_of(lower - 1)
        levels = lower
    return at


def _places(height: int, depth: int) -> np.ndarray:
    """The addresses of a whole depth."""
    return once(("veb", height, depth), lambda: address(height, depth, np.arange(FANOUT**depth)))


def _up(level: list[str]) -> list[str]:
    return [hashlib.sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]


def _raw(hexes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(-1, DIGEST)


def build_block(leaves: list[bytes], whole: bool) -> tuple[int, bytes]:
    """Height and nodes of a block, in layout order. ``whole``: other blocks stand beside it, so it has all levels."""
    height, most = 0, 1
    while most < len(leaves) or whole and height < HEIGHT:
        height, most = height + 1, most * FANOUT
    nodes = np.zeros((nodes_of(height), DIGEST), np.uint8)
    level = [x.hex() for x in leaves]
    for depth in range(height, -1, -1):
        nodes[_places(height, depth)[: len(level)]] = _raw(level)
        level = _up(level)
    return height, nodes.tobytes()


class Block:
    """A stored block, read by addresses."""

    def __init__(self, height: int, n: int, nodes: bytes) -> None:
        self.height, self.n = height, n
        table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        self.levels = []
        for depth in range(height, 0, -1):
            count = -(-n // FANOUT ** (height - depth))
            text = table[_places(height, depth)[:count]].tobytes()
            self.levels.append((count, text))

    def siblings(self, leaf: int) -> tuple[bytes, bytes]:
        """The way up from a leaf: its place and the length of its run, level by level, and the others of each run."""
        shape, others = bytearray(), []
        for count, text in self.levels:
            start = leaf - leaf % FANOUT
            end = min(start + FANOUT, count)
            shape += bytes((leaf - start, end - start))
            others.append(text[DIGEST * start : DIGEST * leaf] + text[DIGEST * (leaf + 1) : DIGEST * end])
            leaf //= FANOUT
        return bytes(shape), b"".join(others)


def fold(leaf: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and the siblings on its way lead to."""
    node, others, at = leaf.hex(), siblings.hex(), 0
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        left, right = at + 2 * DIGEST * place, at + 2 * DIGEST * (size - 1)
        node = hashlib.sha256((others[at:left] + node + others[left:right]).encode()).hexdigest()
        at = right
    return bytes.fromhex(node)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its text, or ``-`` for null."""
    parts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def tree_key(group: Column) -> Column:
    """A group as a text that sorts as the group does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their place in the partition's run of their tree."""
    last, length = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        runs = codes.indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        place = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
        names = codes.dictionary.to_pylist()
        if names[runs[0]] == last:
            place[: first[1] if len(first) > 1 else len(runs)] += length
        last, length = names[runs[-1]], int(place[-1]) + 1
        part = pa.array(np.full(len(runs), task_number(), np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, part, pa.array(place.astype(np.int64))], [*batch.schema.names, "part", "place"])


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows ``tree, id, leaf, carried`` with their place in their tree by ``order``."""
    rows = written(with_rows(rows, "row"), "merkle-leaves")
    parts = partitions_for(rows.count(), PART_ROWS, cores(rows))
    keys = ["tree", *order, "row"]
    ddl = "tree string, id long, leaf binary, carried binary, part int, place long"
    sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("tree", "id", "leaf", "carried")
    ranked = written(sorted_rows.mapInArrow(_numbered, ddl), "merkle-ranked")
    runs = ranked.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Rows are sorted by tree, so only the first tree of a partition began before it: at most a row per partition.
    carry = runs.withColumn("before", before).where("before > 0").select("tree", "part", "before")
    joined = ranked.join(F.broadcast(carry), ["tree", "part"], "left")
    return joined.select("tree", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "leaf", "carried")


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    leaves, block = table.column("leaf").to_pylist(), key[1].as_py()
    height, nodes = build_block(leaves, block > 0)
    # The root of a subtree comes first in its layout.
    row = [[key[0].as_py()], [block], [height], [len(leaves)], [nodes], [nodes[:DIGEST]]]
    return pa.Table.from_batches([rows_out(BLOCKS, row)])


def _block_of(pos: str) -> Column:
    return F.expr(f"{pos} div {WIDTH}").alias("block")


def _write_tiers(leaves: DataFrame, path: str) -> None:
    """All blocks above the leaves, a folder per tier."""
    spark, tier = leaves.sparkSession, 0
    while True:
        level = leaves.select("tree", _block_of("pos"), "pos", "leaf").groupBy("tree", "block").applyInArrow(_block, BLOCKS_DDL)
        level.write.parquet(f"{path}/tier={tier}")
        blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/tier={tier}")
        # A tree whose first block has room left ends there.
        rising = blocks.where((F.col("block") > 0) | (F.col("n") == WIDTH))
        if rising.isEmpty():
            return
        leaves, tier = rising.select("tree", F.col("block").alias("pos"), F.col("root").alias("leaf")), tier + 1


def _tiers(spark: SparkSession, path: str) -> list[DataFrame]:
    found = spark.read.schema(f"{BLOCKS_DDL}, tier int").parquet(path)
    last = found.agg(F.max("tier")).first()[0]
    return [spark.read.schema(BLOCKS_DDL).parquet(f"{path}/tier={t}") for t in range(0 if last is None else last + 1)]


def _done(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("block") == 0) & (F.col("n") < WIDTH))


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ways to the root of all blocks of the next lower tier, from those of their parents."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["height"], row["n"], row["nodes"])
            ways = [block.siblings(i) for i in range(row["n"])]
            n = row["n"]
            first = row["block"] * WIDTH
            yield rows_out(
                PATHS,
                [
                    [row["tree"]] * n,
                    list(range(first, first + n)),
                    [s + row["shape"] for s, _ in ways],
                    [o + row["siblings"] for _, o in ways],
                    [row["subroot"]] * n,
                    [row["root"]] * n,
                ],
            )


def _ways(tiers: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The way from the root of each lowest block to the end. ``above`` has one per tree, from its root on: tree, shape, siblings, root."""
    nothing = [F.lit(b"").alias("shape"), F.lit(b"").alias("siblings"), F.lit(None).cast("binary").alias("root")]
    ways = None
    for tier in range(len(tiers) - 1, -1, -1):
        tops = _done(tiers[tier]).select("tree", "block", F.col("root").alias("subroot"))
        own = (tops.select("*", *nothing) if above is None else tops.join(above, "tree")).select(*PATHS.names)
        ways = own if ways is None else own.unionByName(ways)
        if tier:
            blocks = tiers[tier].select("tree", "block", "height", "n", "nodes")
            ways = written(blocks.join(ways, ["tree", "block"]).mapInArrow(_below, PATHS_DDL), "merkle-ways")
    return ways


def _leaf_proofs(key: tuple[pa.Scalar, ...], leaves: pa.Table, blocks: pa.Table) -> pa.Table:
    if not leaves.num_rows or not blocks.num_rows:
        return pa.Table.from_batches([rows_out(PROOFS, [[]] * len(PROOFS))])
    row = blocks.to_pylist()[0]
    block = Block(row["height"], row["n"], row["nodes"])
    first = row["block"] * WIDTH
    ways = [block.siblings(pos - first) for pos in leaves.column("pos").to_pylist()]
    n = len(ways)
    columns = [leaves.column(c).combine_chunks() for c in ("tree", "id", "leaf", "carried")]
    shapes, siblings = [s + row["shape"] for s, _ in ways], [o + row["siblings"] for _, o in ways]
    return pa.Table.from_batches([rows_out(PROOFS, [*columns, shapes, siblings, [row["subroot"]] * n, [row["root"]] * n])])


def _proofs(leaves: DataFrame, tiers: list[DataFrame], above: DataFrame | None) -> DataFrame:
    lowest = tiers[0].select("tree", "block", "height", "n", "nodes").join(_ways(tiers, above), ["tree", "block"])
    own = leaves.select("tree", _block_of("pos"), "pos", "id", "leaf", "carried")
    return own.groupBy("tree", "block").cogroup(lowest.groupBy("tree", "block")).applyInArrow(_leaf_proofs, PROOFS_DDL)


def build_manifest(
    df: DataFrame, path: str, group_col: str = "source", id_col: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: Column | None = None,
) -> None:
    """Writes the manifest of a table into a new folder: its leaves, and the blocks of all trees.

    ``carry`` is a binary column that is kept with each leaf and comes back with its proof.
    """
    carried = F.lit(None).cast("binary") if carry is None else carry
    rows = df.select(
        tree_key(F.col(group_col)).alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        carried.alias("carried"),
    )
    spark = df.sparkSession
    _ranked(rows, ["id", "leaf"]).write.parquet(f"{path}/leaves")
    _write_tiers(spark.read.schema(LEAVES_DDL).parquet(f"{path}/leaves"), f"{path}/blocks")
    roots = None
    for blocks in _tiers(spark, f"{path}/blocks"):
        own = _done(blocks).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("id"), F.col("root").alias("leaf"), F.encode("tree", "utf-8").alias("carried"))
        roots = own if roots is None else roots.unionByName(own)
    if roots is None:
        roots = rows.where("false").select("tree", "id", "leaf", "carried")
    _ranked(roots, ["carried"]).write.parquet(f"{path}/groups")
    _write_tiers(spark.read.schema(LEAVES_DDL).parquet(f"{path}/groups"), f"{path}/top")


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """One row per leaf: ``tree, id, leaf, carried``, the ``shape`` and ``siblings`` of its way up, ``subroot`` and ``root``."""
    read = lambda name: spark.read.schema(LEAVES_DDL).parquet(f"{path}/{name}")
    top, tiers = _tiers(spark, f"{path}/top"), _tiers(spark, f"{path}/blocks")
    if not tiers:
        return spark.createDataFrame([], PROOFS_DDL)
    groups = _proofs(read("groups"), top, None)
    above = groups.select(F.decode("carried", "utf-8").alias("tree"), "shape", "siblings", F.col("subroot").alias("root"))
    return _proofs(read("leaves"), tiers, written(above, "merkle-groups"))


def folded(df: DataFrame, leaf: Column, into: str = "folded") -> DataFrame:
    """Rows of proofs with the root that ``leaf`` leads to."""
    fields = [f for f in df.schema.fields if f.name != into]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{into}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__leaf", "shape", "siblings")), strict=True)
            ends = pa.array([fold(*row) for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ends], [*batch.schema.names[:-1], into])

    return df.select(*(f.name for f in fields), leaf.alias("__leaf")).mapInArrow(run, ddl)


def is_tampered(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is even; a null id is not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 2 == 0, F.lit(False))


def verify_tampering(df: DataFrame, path: str) -> DataFrame:
    """The manifest of a table of documents, checked against copies whose texts lost their line feeds in every second row.

    One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    docs = df.select(*names)
    lost = F.when(is_tampered(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf_hash([*(F.col(c) for c in names[:-1]), lost])
    build_manifest(docs, path, carry=tampered)
    checked = folded(proofs(df.sparkSession, path), F.col("carried"))
    text = lambda c: F.lower(F.hex(c))
    return checked.select(
        F.col("id").alias("doc_id"),
        *(text(c).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(F.encode(text("siblings"), "utf-8"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
