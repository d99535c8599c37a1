"""Boilerplate lines by their frequency on a site.

A line's share is the number of pages of its host that contain it, divided by all pages of the host.
Lines over a ratio are dropped from every page of that host. Each page names a line once, and Spark
adds the counts up before they are shuffled. A host has at most (lines per page / ratio) such lines, so
they come back to its pages as one array; hosts are salted for that join, since one host may have a
third of all pages.

Defined cases: a null or empty page has no lines; a page without a host belongs to the host ``""``;
blank lines don't count; a line that a page repeats counts once and goes, or stays, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Salts that the pages of a host are dealt to.
SALTS = 32

# What ends a line in a web page, and what isn't text.
NOT_TEXT = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
LINE_END = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def lines_of(html: Column) -> Column:
    """The trimmed lines of a page's text that aren't blank."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), NOT_TEXT, "")
    text = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def drop_frequent_lines(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    ratio: float = 0.5,
    least_pages: int = 3,
) -> DataFrame:
    """Each page's id, host, number of lines and of dropped lines, and the text that stays.

    Lines on more than ``ratio`` of a host's pages go; hosts with fewer than ``least_pages`` pages keep all.
    """
    pages = df.select(
        F.col(id_col).alias("id"),
        host_of(F.col(url_col).cast("string")).alias("host"),
        lines_of(F.col(html_col).cast("string")).alias("lines"),
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = (
        # No line on fewer pages than this can be frequent on a host with enough pages.
        counts.where(F.col("n") > F.lit(ratio * least_pages))
        .join(totals.where(F.col("pages") >= least_pages), "host")
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("frequent"))
    )
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = pages.withColumn("salt", F.pmod(F.xxhash64("id", "lines"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kept = F.when(F.col("frequent").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("frequent"), x))
    )
    return found.select(
        F.col("id").alias(id_col),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        kept.alias("kept"),
    ).select(
        id_col,
        "host",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
