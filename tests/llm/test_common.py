"""Memory that the steps of tasks share: batches from Spark, and what is given back."""

from __future__ import annotations

import pyarrow as pa

from weirgate.llm import common
from weirgate.llm.common import BATCH_BYTES, BATCH_KEY, tidy, written


def test_python_steps_of_written_tables_get_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["nbytes", "n"])

    before = spark.conf.get(BATCH_KEY)
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('text', 20000) AS text")
    found = written(texts.mapInArrow(sizes, "nbytes long, n long"), "batch-sizes").collect()
    assert sum(r.n for r in found) == 400
    assert max(r.nbytes for r in found) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH_KEY) == before


def test_a_step_gives_memory_back_before_and_after(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))

    def run(batches):
        for batch in batches:
            told.append(batch)
            yield batch

    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert told == ["back", 1, 2, "back"]
