"""Pages of a sorted index: snapshots that outlive a session, and a clustered copy in which any page is found by its place.

A snapshot is a manifest, written under an id: the files that a table had at that moment, with their lengths. It is opened by
its id in any session; files that came later aren't seen, and a file that has gone or changed since is an error.

A page index is a copy of the rows in sort order, cut into parts of bounded size, with the first and the last key and the number of rows of
each part. A page by number is found by adding up those numbers, a page behind a key by comparing the parts' last keys; either reads
the one or two parts that hold its rows, wherever it is in the order. Nothing but the list of parts reaches the driver.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest, NotFound
from ..session import scratch_path
from .search import after_key, ordering, path_column, sort_keys

PART_ROWS = 1_000_000
PART, ROW = "page_part", "page_row"


# -- snapshots -----------------------------------------------------------------------------------


def _listed(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lengths of files; their contents are not read."""
    return spark.read.format("binaryFile").load(list(files)).select("path", "length")


def take_snapshot(spark: SparkSession, location: str, root: str, format: str = "parquet") -> str:
    """Writes the list of a table's present files into ``root`` and gives its id."""
    table = spark.read.format(format).load(location)
    files, snapshot = table.inputFiles(), uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    folder = not any(c in location for c in "*?[{") and path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    about = (format, table.schema.json(), location if folder else "")
    rows = _listed(spark, files) if files else spark.createDataFrame([], "path string, length long")
    marked = [F.lit(x).alias(n) for n, x in zip(("format", "schema", "base"), about, strict=True)]
    head = spark.createDataFrame([(None, 0)], "path string, length long")
    rows.unionByName(head).select("path", "length", *marked).write.parquet(f"{root}/{snapshot}")
    return snapshot


def open_snapshot(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """The table as it was when the snapshot was taken."""
    if not snapshot.isalnum():
        raise InvalidRequest("a snapshot id is made of letters and digits")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{snapshot}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise NotFound(f"no snapshot '{snapshot}'")
    manifest = spark.read.parquet(f"{root}/{snapshot}")
    head = manifest.where("path IS NULL").first()
    schema = T.StructType.fromJson(json.loads(head["schema"]))
    files = [r["path"] for r in manifest.where("path IS NOT NULL").select("path").orderBy("path").collect()]  # a listing, as of any read
    if not files:
        return spark.createDataFrame([], schema)
    try:
        same = _listed(spark, files).join(manifest, ["path", "length"]).count() == len(files)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "FileNotFound" not in str(error):
            raise
        same = False
    if not same:
        raise NotFound(f"files of snapshot '{snapshot}' have gone or changed")
    base = {"basePath": head["base"]} if head["base"] else {}
    return spark.read.format(head["format"]).schema(schema).options(**base).load(files)


# -- clustered pages -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PageIndex:
    """A sorted copy in a folder: its keys, and the rows of each part, in order."""

    path: str
    keys: tuple[tuple[str, str, str], ...]
    schema: T.StructType
    parts: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def starts(self) -> list[int]:
        return [0, *accumulate(self.counts)]

    def rows(self, spark: SparkSession, parts: Sequence[int]) -> DataFrame:
        """The rows of some parts with their place in the order, from 1; other folders aren't listed."""
        schema = T.StructType([*self.schema.fields, T.StructField(ROW, T.LongType()), T.StructField(PART, T.IntegerType())])
        if not parts:
            return spark.createDataFrame([], schema).withColumn("place", F.lit(0).cast("long"))
        folders = [f"{self.path}/rows/{PART}={p}" for p in parts]
        stored = spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders)
        # A number per part that is read.
        first = dict(zip(self.parts, self.starts, strict=False))
        starts = spark.createDataFrame([(p, first[p]) for p in parts], f"{PART} int, page_start long")
        return stored.join(F.broadcast(starts), PART).withColumn("place", F.col("page_start") + F.col(ROW) + 1).drop("page_start")


def build_page_index(
    df: DataFrame, sort: Sequence[tuple[str, str, str]], id_column: str, path: str | None = None, *, part_rows: int = PART_ROWS
) -> PageIndex:
    """Writes the rows in the order of ``sort`` and the unique id into a new folder."""
    if {PART, ROW} & set(df.columns):
        raise InvalidRequest(f"the column names '{PART}' and '{ROW}' are the index's own")
    spark = df.sparkSession
    path = path or scratch_path(spark, "pages")
    keys = sort_keys(sort, id_column)
    order = ordering(df, keys)
    parts = max(1, -(-df.count() // part_rows))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The numbers are those of one write, which is what is read from then on.
    numbered = dealt.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered.write.partitionBy(PART).parquet(f"{path}/rows")
    schema = T.StructType([*df.schema.fields, T.StructField(ROW, T.LongType()), T.StructField(PART, T.IntegerType())])
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    own = F.struct(*[path_column(stored, name).alias(f"key_{i}") for i, (name, _, _) in enumerate(keys)])
    ends = stored.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.min_by(own, ROW).alias("first"), F.max_by(own, ROW).alias("last"))
    about = json.dumps({"keys": keys, "schema": df.schema.json()})
    ends.withColumn("about", F.lit(about)).write.parquet(f"{path}/parts")
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return open_page_index(spark, path)


def open_page_index(spark: SparkSession, path: str) -> PageIndex:
    """The index that was built into ``path``; reads a row per part."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    parts = spark.read.parquet(f"{path}/parts").select(PART, "n").orderBy(PART).collect()
    keys = tuple(tuple(k) for k in about["keys"])
    return PageIndex(path, keys, T.StructType.fromJson(json.loads(about["schema"])), tuple(r[PART] for r in parts), tuple(r["n"] for r in parts))


def page_number(spark: SparkSession, index: PageIndex, number: int, size: int = 512) -> DataFrame:
    """Page ``number``, from 0, with each row's ``place``."""
    if number < 0 or size < 1:
        raise InvalidRequest("pages are numbered from 0 and have a row at least")
    starts, first = index.starts, number * size
    low, high = bisect_right(starts, first) - 1, bisect_right(starts, first + size - 1) - 1
    some = [p for i, p in enumerate(index.parts) if low <= i <= high]
    rows = index.rows(spark, some).where((F.col("place") > first) & (F.col("place") <= first + size))
    return rows.orderBy("place").drop(PART, ROW)


def page_behind(spark: SparkSession, index: PageIndex, after: Sequence | None = None, size: int = 512) -> DataFrame:
    """The page behind a key, with each row's ``place``; None gives the first page."""
    if after is None:
        return page_number(spark, index, 0, size)
    ends = spark.read.parquet(f"{index.path}/parts")
    named = [(f"last.key_{i}", order, missing) for i, (_, order, missing) in enumerate(index.keys)]
    found = ends.where(after_key(ends, named, after)).agg(F.min(PART)).first()[0]
    if found is None:
        return index.rows(spark, []).drop(PART, ROW)
    low = index.parts.index(found)
    # The page begins in that part; from the next ones on it needs no more than its own rows.
    high, held = low, 0
    while held < size and high + 1 < len(index.parts):
        high += 1
        held += index.counts[high]
    rows = index.rows(spark, index.parts[low : high + 1])
    return rows.where(after_key(rows, index.keys, after)).orderBy("place").limit(size).drop(PART, ROW)


def places(spark: SparkSession, index: PageIndex) -> DataFrame:
    """All rows with their place; nothing is sorted again."""
    return index.rows(spark, index.parts).drop(PART, ROW)
