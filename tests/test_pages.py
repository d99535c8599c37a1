from __future__ import annotations

import os
import random
import shutil

import pytest

from weirgate.errors import InvalidRequest, NotFound
from weirgate.operators import pages, search

SORT = (("n", "desc", "_last"), ("name", "asc", "_first"))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.choice([None, "a", "b", "ä"]), (i % 5,)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int, name string, deep struct<k: int>")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, (r[2] or "").encode(), r[0])
    return df, [r[0] for r in sorted(rows, key=key)]


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    return pages.build_page_index(data[0], SORT, "id", str(tmp_path_factory.mktemp("pages") / "i"), part_rows=400)


def test_pages_by_number_are_the_sort(spark, data, index):
    _, want = data
    again = pages.open_page_index(spark.newSession(), index.path)
    for number, size in ((0, 100), (1, 100), (7, 333), (29, 100), (30, 100), (0, 5000), (2, 1000), (999, 3)):
        got = pages.page_number(spark, again, number, size).collect()
        assert [r["id"] for r in got] == want[number * size : (number + 1) * size]
        assert [r["place"] for r in got] == list(range(number * size + 1, number * size + 1 + len(got)))
    with pytest.raises(InvalidRequest):
        pages.page_number(spark, index, -1)


def test_pages_behind_keys_are_the_sort(spark, data, index):
    _, want = data
    after, found = None, []
    while True:
        page = pages.page_behind(spark, index, after, 450).collect()
        found += page
        if len(page) < 450:
            break
        after = search.next_key(page[-1], SORT, "id")
    assert [r["id"] for r in found] == want and [r["place"] for r in found] == list(range(1, 3001))
    last = search.next_key(found[-1], SORT, "id")
    assert pages.page_behind(spark, index, last, 10).count() == 0
    # A key that no row has.
    between = pages.page_behind(spark, index, [3, "é", 0], 5).collect()
    order = [r["id"] for r in found]
    assert [r["id"] for r in between] == order[order.index(between[0]["id"]) :][:5] and between[0]["n"] == 2


def test_late_pages_read_no_more_parts_than_early_ones(spark, index):
    def files(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan.execute().count()
        return len(df.inputFiles())

    assert files(pages.page_number(spark, index, 0, 100)) == 1
    assert files(pages.page_number(spark, index, 27, 100)) <= 2
    total = len(index.parts)
    assert total >= 6 and files(pages.places(spark, index)) >= total
    late = search.next_key(pages.page_number(spark, index, 2800, 1).first(), SORT, "id")
    assert files(pages.page_behind(spark, index, late, 100)) <= 2


def test_places_and_odd_tables(spark, data, index, tmp_path):
    df, want = data
    assert {r["id"]: r["place"] for r in pages.places(spark, index).collect()} == {i: p for p, i in enumerate(want, 1)}
    empty = pages.build_page_index(df.where("false"), SORT, "id", str(tmp_path / "e"))
    assert pages.page_number(spark, empty, 0).count() == pages.places(spark, empty).count() == 0
    assert pages.page_behind(spark, empty, [1, "a", 5]).count() == 0
    nested = pages.build_page_index(df, (("deep.k", "desc", "_last"),), "id", str(tmp_path / "n"), part_rows=500)
    assert [r["deep"]["k"] for r in pages.page_number(spark, nested, 1, 600).collect()] == [3] * 600
    with pytest.raises(InvalidRequest):
        pages.build_page_index(df.withColumnRenamed("n", pages.ROW), (), "id", str(tmp_path / "c"))


def test_a_snapshot_is_opened_in_another_session(spark, data, tmp_path):
    df, want = data
    table, root = str(tmp_path / "t"), str(tmp_path / "snapshots")
    df.repartition(4).write.parquet(table)
    snapshot = pages.take_snapshot(spark, table, root)
    first = search.page_after(pages.open_snapshot(spark, root, snapshot), SORT, "id", None, 1000).collect()
    df.selectExpr("id + 10000 AS id", "n", "name", "deep").write.mode("append").parquet(table)
    found, after = [r["id"] for r in first], search.next_key(first[-1], SORT, "id")
    while len(found) < 3000:
        other = spark.newSession()
        page = search.page_after(pages.open_snapshot(other, root, snapshot), SORT, "id", after, 1000).collect()
        found, after = found + [r["id"] for r in page], search.next_key(page[-1], SORT, "id")
    assert found == want and spark.read.parquet(table).count() == 6000
    with pytest.raises(NotFound):
        pages.open_snapshot(spark, root, "nosuch")
    with pytest.raises(InvalidRequest):
        pages.open_snapshot(spark, root, "../t")
    old = next(os.path.join(table, f) for f in os.listdir(table) if f.endswith(".parquet") and f in " ".join(pages.open_snapshot(spark, root, snapshot).inputFiles()))
    shutil.copyfile(next(os.path.join(table, f) for f in os.listdir(table) if f.endswith(".parquet") and os.path.join(table, f) != old), old)
    with pytest.raises(NotFound):
        pages.open_snapshot(spark, root, snapshot)


def test_snapshots_of_partitioned_and_empty_tables(spark, data, tmp_path):
    df, _ = data
    table, root = str(tmp_path / "t"), str(tmp_path / "s")
    df.write.partitionBy("n").parquet(table)
    snapshot = pages.take_snapshot(spark, table, root)
    got = pages.open_snapshot(spark, root, snapshot)
    assert sorted(tuple(r) for r in got.select("id").collect()) == sorted(tuple(r) for r in df.select("id").collect())
    assert {r["n"] for r in got.select("n").distinct().collect()} == {None, 1, 2, 3}
    df.where("false").select("id").write.parquet(str(tmp_path / "e"))
    assert pages.open_snapshot(spark, root, pages.take_snapshot(spark, str(tmp_path / "e"), root)).count() == 0
