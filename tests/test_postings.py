from __future__ import annotations

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from weirgate.errors import InvalidRequest
from weirgate.operators import postings, search


def words(text):
    return re.findall(r"\w+", text.lower())


def with_phrase(text, asked):
    own = words(text)
    return any(own[i : i + len(asked)] == asked for i in range(len(own) - len(asked) + 1))


TEXTS = [
    "The quick brown fox",
    "quick, quick -- QUICK fox",
    "fox quick",
    "",
    None,
    "a b a b c a b a b d",
    "to be or not to be",
    "naïve Ünïcode_word 42",
    " ".join(f"w{i}" for i in range(5000)) + " the end",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [t, "second fox"] if t else None) for i, t in enumerate(TEXTS)], "key long, body string, parts array<string>")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return postings.build_text_index(docs, "key", ["body", "parts"], str(tmp_path_factory.mktemp("index") / "text"), buckets=16)


PHRASES = ["quick fox", "quick quick", "a b a b d", "a b a b c", "to be or not to be", "be to", "the end", "ünïcode_word 42", "fox", "w4998 w4999 the end", "fox second", "", "none such"]


@pytest.mark.parametrize("text", PHRASES)
def test_the_index_gives_what_the_scan_gives(spark, docs, index, text):
    for clause in ({"match": {"body": text}}, {"match": {"body": {"query": text, "operator": "and"}}}, {"match_phrase": {"body": text}}, {"match_phrase": {"parts": text}}, {"match": {"parts": {"query": text, "operator": "and"}}}):
        body = {"query": clause, "_source": ["key"]}
        want = sorted(r.key for r in search.search(docs, body, "key").collect())
        assert sorted(r.key for r in search.search(docs, body, "key", text_index=index).collect()) == want, clause
    asked = words(text)
    hits = {i for i, t in enumerate(TEXTS) if t and asked and with_phrase(t, asked)}
    assert {r.id for r in postings.matching_phrase(spark, index, "body", text).collect()} == hits


def test_long_phrases(spark, docs, index):
    text = " ".join(f"w{i}" for i in range(100, 300))
    assert [r.id for r in postings.matching_phrase(spark, index, "body", text).collect()] == [8]
    assert postings.matching_phrase(spark, index, "body", text + " w7").count() == 0
    assert [r.id for r in postings.matching(spark, index, "body", text, "and").collect()] == [8]


def test_a_search_reads_the_folders_of_its_words_alone(spark, docs, index, tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(index.path, copy)
    spread = spark.createDataFrame([("quick",), ("fox",)], "word string").select(postings._bucket(F.col("word"), 16)).collect()
    kept = {f"bucket={r[0]}" for r in spread}
    gone = 0
    for folder in os.listdir(f"{copy}/field=body"):
        if folder not in kept:
            for name in os.listdir(f"{copy}/field=body/{folder}"):
                open(f"{copy}/field=body/{folder}/{name}", "w").close()  # not a Parquet file any more
                gone += 1
    again = postings.open_text_index(spark, copy)
    assert gone > 3 and sorted(r.id for r in postings.matching_phrase(spark, again, "body", "quick fox").collect()) == [1]
    plan = postings.matching(spark, again, "body", "quick fox")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "PushedFilters: [In(word" in plan.replace("PushedFilters: [IsNotNull(word), In(word", "PushedFilters: [In(word")


def test_a_word_of_all_documents_is_spread(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("key"), F.concat(F.lit("common word number "), "id").alias("body"))
    index = postings.build_text_index(df, "key", ["body"], str(tmp_path / "i"), part_rows=500)
    rows = spark.read.parquet(index.path).where("word = 'common'")
    assert rows.select(F.input_file_name()).distinct().count() > 3
    assert postings.matching_phrase(spark, index, "body", "common word").count() == 4000
    assert [r.id for r in postings.matching_phrase(spark, index, "body", "number 3999").collect()] == [3999]


def test_repeated_ids_empty_tables_and_other_fields(spark, docs, tmp_path):
    twice = docs.unionByName(docs)
    index = postings.build_text_index(twice, "key", ["body"], str(tmp_path / "i"))
    body = {"query": {"match_phrase": {"body": "quick fox"}}, "_source": ["key"]}
    assert [r.key for r in search.search(twice, body, "key", text_index=index).collect()] == [1, 1]
    other = {"query": {"match": {"parts": "second"}}, "_source": ["key"]}
    assert search.search(docs, other, "key", text_index=index).count() == 7
    with pytest.raises(InvalidRequest):
        index.postings(spark, "parts", ["x"])
    empty = postings.build_text_index(docs.where("false"), "key", ["body"], str(tmp_path / "e"))
    assert search.search(docs, body, "key", text_index=empty).count() == 0


def test_a_task_sorts_few_postings(spark, tmp_path):
    """A task may take 3.6 GB; a sorted posting is some 120 bytes, and ranges are dealt by a sample, so some are twice as large."""
    assert postings.PART_ROWS * 120 * 2 < 3.6e9 / 4
    # The shortest words there are: as many postings as the lengths of the texts allow.
    df = spark.range(40).select(F.col("id").alias("key"), F.repeat(F.lit("a "), 300).alias("body"))
    index = postings.build_text_index(df, "key", ["body"], str(tmp_path / "i"), part_rows=1000)
    files = [r.n for r in spark.read.parquet(index.path).where("word = 'a'").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(files) == 40 * 300 and max(files) < 2000
