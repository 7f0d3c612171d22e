"""Numbering of rows in groups of any size and order."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vacancia.operators import windows


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with half of all rows, one instant far away, nulls, ties in text."""
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.when(F.col("id") == 7, F.lit("1600-01-01")).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.concat(F.lit("2024-03-01 00:"), F.lpad((F.col("id") * 13 % 60).cast("string"), 2, "0"), F.lit(":00"))).cast("timestamp_ntz").alias("at"),
        F.concat(F.lit("same start "), (F.col("id") * 7919 % 1000).cast("string")).alias("name"),
    )
    return rows.repartition(6)


@pytest.mark.parametrize("order", [["id"], ["at", "id"], ["name", "id"]])
@pytest.mark.parametrize("groups", [["g"], []])
def test_numbers_equal_one_window(skewed, order, groups):
    got = windows.numbered(skewed, groups, order, range_rows=1000)
    want = skewed.withColumn("want", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    assert got.columns == [*skewed.columns, "_n"]
    joined = got.join(want.select("id", "want"), "id")
    assert joined.where(F.col("_n") == F.col("want")).count() == 20_000 == got.count()


@pytest.mark.parametrize("order", [["at", "id"], ["name", "id"]])
def test_no_range_is_large(skewed, order):
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(["g", *order])))
    edges = windows._edges(skewed, key, 20_000, 20)
    sizes = [r["count"] for r in skewed.groupBy(windows._range_number(key, edges, 20)).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 1000


def test_batches_of_small_and_of_large_tables_agree(skewed, monkeypatch):
    few = windows.batches(skewed, ["g"], ["id"], 24)
    monkeypatch.setattr(windows.numbered, "__defaults__", (500,))
    many = windows.batches(skewed, ["g"], ["id"], 24)
    assert few.exceptAll(many).count() == 0 and windows.batches(skewed.where("false"), ["g"], ["id"]).count() == 0


def test_counted_and_drawn_in_one_pass(skewed):
    """A table is numbered by one job before its result; edges are found in that job too."""
    key = F.struct(F.col("g").alias("k0"), F.col("id").alias("k1"))
    tracker, group = skewed.sparkSession.sparkContext.statusTracker(), "ranges"
    skewed.sparkSession.sparkContext.setJobGroup(group, group)
    ranges, edges = windows._ranges(skewed, key, 1000)
    drawn = len(tracker.getJobIdsForGroup(group))
    skewed.sparkSession.sparkContext.setJobGroup("count", "count")
    skewed.count()
    assert ranges == 20 and drawn <= len(tracker.getJobIdsForGroup("count"))
    sizes = [r["count"] for r in skewed.groupBy(windows._range_number(key, edges, 20)).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 1000
    assert windows._ranges(skewed.where("false"), key, 1000) == (0, None)
