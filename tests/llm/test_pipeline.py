from __future__ import annotations

import os
import random
import uuid

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_exact import brute as exact_groups
from tests.llm.test_ngram import brute as near_groups
from tests.llm.test_ngram import edited
from tests.llm.test_pii import brute as base_spans
from weirgate.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "he", "in"]) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words[rng.randrange(60)] = "gronkel"
        labels.append((i, int(i % 6 == 0)))
        texts.append(" ".join(words))
    texts += [t + " " for t in texts[1:6]] + [" ".join(edited(rng, texts[i].split(), 1)) for i in (7, 8, 9)]
    texts += ["mail a.b@c.org or 10.0.0.1 " + word(), "", None, " "]
    rows = [(i, t, None if i % 9 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[11], (None, "no id " + word(), None, None, None), (None, texts[13], "en", "s", 3)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def plain(row):
    return row.doc_id, row.text


def test_each_stage_on_what_the_one_before_kept(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        before = [plain(r) for r in docs.collect()]
        docs = pipeline.written(stage(spark, docs, corpus), "test")
        if name != "best-fit packing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{corpus}/documents.parquet").schema.simpleString()
            after = sorted(map(plain, docs.collect()), key=str)
        if name == "toxicity":
            assert after == sorted((r for r in before if "gronkel" not in (r[1] or "")), key=str)
        if name == "exact dedup":
            groups = exact_groups(before)
            assert len(after) == len({g[3] for g in groups}) and sorted({g[1] for g in groups}, key=str) == sorted((k for k, _ in after), key=str)
        if name == "n-gram jaccard join":
            groups = near_groups(before)
            with_words = {c for _, n, c in groups if n}
            assert len(after) == len(with_words) + sum(1 for _, n, _ in groups if not n)
            assert {k for k, t in after if (t or "").strip() and k is not None} == {c for c in with_words if c is not None}
        if name == "personal data":
            assert [k for k, _ in after] == [k for k, _ in sorted(before, key=str)]
            assert all(not base_spans(t) for _, t in after)
            assert {(k, t) for k, t in before if not base_spans(t)} <= set(after)
        kept.append(len(before))
    assert sorted(kept, reverse=True) == kept
    assert {r.doc_id for r in docs.collect()} == {k for k, _ in after}


def test_pipeline_runs_over_the_table(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage, name", [(pipeline.drop_copies, "exact_dedup"), (pipeline.drop_near_copies, "ngram_jaccard_join")])
def test_rows_keep_their_numbers_when_files_are_packed_anew(spark, tmp_path, monkeypatch, stage, name):
    real, key = getattr(pipeline, name), "spark.sql.files.minPartitionNum"

    def with_other_packing_after(rows, **options):
        found = real(rows, **options)
        spark.conf.set(key, "1")
        return found

    monkeypatch.setattr(pipeline, name, with_other_packing_after)
    texts = [" ".join(f"w{i % 30}x{j}" for j in range(20)) for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(20, "doc_id").write.option("maxRecordsPerFile", 2).parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(key, "40")
    try:
        left = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(r.doc_id for r in left) == list(range(30))


@pytest.mark.parametrize("stage", [pipeline.drop_copies, pipeline.drop_near_copies])
def test_texts_are_not_left_in_the_scratch_folder(spark, tmp_path, monkeypatch, stage):
    """What a stage leaves there adds up over the stages: row numbers may stay, copies of the texts may not."""
    # A folder of its own, as other sessions may use the scratch folder at the same time.
    monkeypatch.setattr(common, "scratch_path", lambda _, name: f"{tmp_path}/scratch/{name}-{uuid.uuid4().hex}")
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(1 << 60):x}" for _ in range(300)) for _ in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:50])]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    left = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    kept = sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(f"{tmp_path}/scratch") for x in names)
    assert sorted(r.doc_id for r in left.collect()) == list(range(150))
    assert 0 < kept < sum(map(len, texts)) / 10


@pytest.mark.parametrize("stage", [pipeline.drop_copies, pipeline.drop_near_copies])
def test_rows_of_many_files_and_of_none(spark, tmp_path, stage):
    rows = [(i % 7, f"one two three four five six {i % 3}", "en", "s", 1) for i in range(40)] + [(None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, COLUMNS)
    frame.repartition(6).write.option("maxRecordsPerFile", 2).parquet(f"{tmp_path}/documents.parquet")
    # The smallest id of each group stays, with one row; empty texts are copies of each other, but no near copies.
    from_files, from_memory = (
        sorted(map(plain, stage(spark, docs, str(tmp_path)).collect()), key=str) for docs in (spark.read.parquet(f"{tmp_path}/documents.parquet"), frame)
    )
    want = [(0, f"one two three four five six {i}") for i in range(3)] + [(None, None)] * (1 if stage is pipeline.drop_copies else 2)
    assert from_files == from_memory == sorted(want, key=str)
