"""From raw documents to packed sequences, in five stages.

Each stage gets what the one before it kept, as a written table, and all but the last give documents
with the columns they came with. A row that repeats another in every column is still a row of its own:
stages that drop documents mark rows, not ids. An empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.common import alone, with_rows, written
from weirgate.llm.exact import exact_dedup
from weirgate.llm.ngram import ngram_jaccard_join
from weirgate.llm.packing import pack_documents
from weirgate.llm.pii import find_pii, redact
from weirgate.llm.toxicity import score, train
from weirgate.plans.tables import table

# A document with this score or more goes.
TOXIC_FROM = 0.3
ROW, SCORE, SPANS = "__row", "__toxicity", "__spans"
FILE, PLACE, NUMBER = "__file", "__place", "__number"
# A file has fewer rows than two to this power.
PLACE_BITS = 40


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of a written table with a number each, made of their file's and their place in it: they hold however the files are packed.

    Only the names of the files are written, which Spark lists at the driver anyway. Rows that come from no Parquet file are written as a whole.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return written(with_rows(docs, ROW), name)
    files = written(with_rows(rows.select(FILE).distinct().coalesce(1), NUMBER), name)
    row = F.shiftleft(NUMBER, PLACE_BITS).bitwiseOR(F.col(PLACE)).alias(ROW)
    return rows.join(F.broadcast(files), FILE).select(*docs.columns, row)


def _without(rows: DataFrame, dropped: Callable[[], DataFrame], name: str) -> DataFrame:
    return rows.join(alone(rows.sparkSession, dropped, name), ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, into=SCORE).where(F.col(SCORE) < TOXIC_FROM).drop(SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs, "rows-for-copies")
    return _without(rows, lambda: exact_dedup(rows, row_col=ROW).where(~F.col("kept")).select(ROW), "dropped-copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    rows = _numbered(docs, "rows-for-near-copies")

    def dropped() -> DataFrame:
        return ngram_jaccard_join(rows, row_col=ROW).where(F.col(ROW) != F.col("component_row")).select(ROW)

    return _without(rows, dropped, "dropped-near-copies")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets; ``n_chars`` follows the text."""
    found = redact(find_pii(docs).withColumnRenamed("pii", SPANS), spans=SPANS)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(SPANS) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.drop(SPANS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("personal data", hide_personal_data),
    ("best-fit packing", pack),
]
# A trained score, components and tokenizers aren't SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
