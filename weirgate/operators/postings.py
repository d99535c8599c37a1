"""A positional inverted index of text columns, for match and match_phrase.

A posting is a row: field, word, document id, element (of an array column, else 0) and position. Postings are sorted by word,
document and position and dealt by range, so a word that has a third of all rows is spread over many files; the sorted numbers are
stored as differences (Parquet's delta encoding). Folders are by field and by a hash of the word: a search lists
the folders of its words alone, and the row groups of other words in them are skipped by their statistics.

An index is opened by its path, also in another session. It covers the documents that it was built of.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest
from ..session import scratch_path
from . import search

# Folders of words, and postings of a file at most, more or less: a task sorts those of one file in memory.
BUCKETS, PART_ROWS = 64, 2_000_000
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder: its fields, and the type of its document ids."""

    path: str
    fields: tuple[str, ...]
    id_type: str
    buckets: int

    def postings(self, spark: SparkSession, field: str, words: Sequence[str]) -> DataFrame:
        """The postings of some words. Only their folders are listed and read."""
        if field not in self.fields:
            raise InvalidRequest(f"'{field}' is not a field of the text index")
        ddl = f"word string, id {self.id_type}, element int, position long, field string, bucket int"
        rows = spark.read.schema(ddl).option("recursiveFileLookup", "false").parquet(self.path)
        asked = list(dict.fromkeys(words))
        folders = sorted({r[0] for r in spark.createDataFrame([(w,) for w in asked], "word string").select(_bucket(F.col("word"), self.buckets)).collect()})
        rows = rows.where((F.col("field") == field) & F.col("bucket").isin(folders) & F.col("word").isin(asked))
        return rows.select("word", "id", "element", "position")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _postings(df: DataFrame, id_column: str, field: str) -> DataFrame:
    column = search.path_column(df, field)
    if isinstance(search._type_of(df, column), T.ArrayType):
        elements = df.select(search.path_column(df, id_column).alias("id"), F.posexplode(column).alias("element", "__text"))
    else:
        elements = df.select(search.path_column(df, id_column).alias("id"), F.lit(0).alias("element"), column.alias("__text"))
    words = elements.select("id", "element", F.posexplode(search.words_of(F.col("__text").cast("string"))).alias("position", "word"))
    return words.select(F.lit(field).alias("field"), "word", "id", "element", F.col("position").cast("long").alias("position"))


def build_text_index(
    df: DataFrame, id_column: str, fields: Sequence[str], path: str | None = None, *, buckets: int = BUCKETS, part_rows: int = PART_ROWS
) -> TextIndex:
    """Writes the index of some text fields into a new folder; without a path into the scratch folder."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "text-index")
    rows = reduce(lambda a, b: a.unionByName(b), [_postings(df, id_column, f) for f in fields]).withColumn("bucket", _bucket(F.col("word"), buckets))
    # A word and what parts it from the next one are two signs or more, so the lengths bound the postings without splitting the texts.
    lengths = [F.sum(F.length(F.concat_ws(" ", search.path_column(df, f).cast("string"))) + 1) for f in fields]
    most = sum(n or 0 for n in df.agg(*lengths).first()) // 2
    parts = max(spark.sparkContext.defaultParallelism, -(-most // part_rows))
    order = ["field", "bucket", "word", "id", "element", "position"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.write.partitionBy("field", "bucket").options(**DELTAS).parquet(path)
    id_type = df.select(search.path_column(df, id_column).alias("id")).schema["id"].dataType.simpleString()
    about = [(list(fields), id_type, buckets)]
    spark.createDataFrame(about, "fields array<string>, id_type string, buckets int").coalesce(1).write.parquet(f"{path}/_about")
    return open_text_index(spark, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    about = spark.read.parquet(f"{path}/_about").first()
    return TextIndex(path, tuple(about.fields), about.id_type, about.buckets)


def matching(spark: SparkSession, index: TextIndex, field: str, text: str, operator: str = "or") -> DataFrame:
    """The distinct ids of documents with any (``or``) or all (``and``) words of a text."""
    asked = list(dict.fromkeys(search.asked_words(text)))
    if operator.lower() not in ("or", "and"):
        raise InvalidRequest(f"unknown match operator '{operator}'")
    found = index.postings(spark, field, asked or [""])
    if operator.lower() == "or" or len(asked) < 2:
        return found.select("id").distinct()
    # A document and word is counted once; the sums are added up before their shuffle.
    bits = F.create_map(*[x for i, w in enumerate(asked) for x in (F.lit(w), F.lit(i))])
    return _complete(found, ["id", "element"], F.element_at(bits, F.col("word")), len(asked))


def _complete(rows: DataFrame, keys: Sequence[str], place: Column, n: int) -> DataFrame:
    """The ids of keys for which all of ``n`` places occur. Places are bits, 60 to a number."""
    numbers = range(0, n, 60)
    marked = rows.withColumn("__at", place)
    inside = [(F.col("__at") >= a) & (F.col("__at") < a + 60) for a in numbers]
    sums = [F.bit_or(F.when(some, F.expr(f"shiftleft(1L, cast(__at - {a} as int))")).otherwise(F.lit(0))).alias(f"__b{a}") for a, some in zip(numbers, inside, strict=True)]
    whole = [F.col(f"__b{a}") == F.lit((1 << min(60, n - a)) - 1) for a in numbers]
    return marked.groupBy(*keys).agg(*sums).where(reduce(lambda a, b: a & b, whole)).select("id").distinct()


def matching_phrase(spark: SparkSession, index: TextIndex, field: str, text: str) -> DataFrame:
    """The distinct ids of documents with the words of a text one after the other.

    Each posting votes for the places where the phrase would begin; a place that all words of the phrase vote for is a hit.
    """
    asked = search.asked_words(text)
    found = index.postings(spark, field, asked or [""])
    if len(asked) < 2:
        return found.select("id").distinct()
    places = {w: [i for i, x in enumerate(asked) if x == w] for w in asked}
    by_word = F.create_map(*[x for w, own in places.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])
    votes = found.withColumn("__place", F.explode(F.element_at(by_word, F.col("word")))).withColumn("__start", F.col("position") - F.col("__place"))
    return _complete(votes, ["id", "element", "__start"], F.col("__place"), len(asked))
