from __future__ import annotations

from weirgate.llm.lines import drop_frequent_lines

SCHEMA = "page_id long, url string, html string, lines string, salt int"


def test_lines_over_the_ratio_go(spark):
    rows = [(i, "http://A.x/p", f"<p>Home</p><p>own {i}</p><p>own {i}</p><div>" + ("half" if i % 2 else "other") + "</div>", "", 1) for i in range(40)]
    rows += [(100, "http://b.x", "<p>Home</p>", "", 1), (101, None, "<p>Home", "", 1), (102, "http://a.x", None, "", 1), (103, "http://a.x/", "", "", 1)]
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.text) for r in drop_frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == ("a.x", 4, 1, "own 3\nown 3\nhalf")
    assert got[100] == ("b.x", 1, 0, "Home") and got[101] == ("", 1, 0, "Home")
    assert got[102] == got[103] == ("a.x", 0, 0, "")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://a.x", "<p>same</p>", "", 1)] * 3
    assert [r.n_dropped for r in drop_frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()] == [1, 1, 1]
    assert drop_frequent_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_share_at_the_ratio_stays_and_low_ratios_count_single_pages(spark):
    rows = [(i, "http://a.x", f"<p>{'half' if i < 4 else 'rest'}</p><p>five</p><p>own {i}</p>" if i < 5 else "<p>none</p>", "", 1) for i in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in drop_frequent_lines(frame).collect()}
    assert got[0] == "half\nown 0" and got[4] == "rest\nown 4" and got[7] == "none"
    assert {r.n_dropped for r in drop_frequent_lines(frame, ratio=0.1).collect()} == {3, 1}


def test_long_pages_hot_hosts_and_null_ids(spark):
    rows = [(i or None, "http://hot.x", "<p>menu</p>" + "".join(f"<p>line {i} {j}</p>" for j in range(3 if i else 20_000)), "", 1) for i in range(300)]
    rows += [(1000 + i, f"http://h{i}.x", "<p>menu</p>", "", 1) for i in range(50)]
    got = {r.page_id: r for r in drop_frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None].n_lines == 20_001 and got[None].n_dropped == 1 and got[5].text == "line 5 0\nline 5 1\nline 5 2"
    assert got[1003].n_dropped == 0
