"""Sequence rules over result pages, and batches."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def page_yield(hits: DataFrame) -> DataFrame:
    """search_id, page_no, new_ok: title-matching URLs first seen on each page of a search."""
    first = hits.groupBy("search_id", "url").agg(F.min("page_no").alias("page_no"))
    ok = hits.where("title_ok").select("search_id", "page_no", "url").distinct()
    new = ok.join(first, ["search_id", "url", "page_no"], "left_semi").groupBy("search_id", "page_no").agg(F.count("*").alias("new_ok"))
    return hits.select("search_id", "page_no").distinct().join(new, ["search_id", "page_no"], "left").withColumn("new_ok", F.coalesce("new_ok", F.lit(0)).cast("long"))


def _until(pages: DataFrame, stops) -> DataFrame:
    last = pages.where(stops).groupBy("search_id").agg(F.min("page_no").alias("last_page"))
    return pages.join(last, "search_id", "left").withColumn("kept", F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))


def early_stop(hits: DataFrame, least: int = 3) -> DataFrame:
    """Pages kept until the first page after page 0 with fewer than `least` new URLs."""
    return _until(page_yield(hits), (F.col("page_no") > 0) & (F.col("new_ok") < least))


def zero_yield_stop(hits: DataFrame) -> DataFrame:
    """Pages kept until the first page without a new URL."""
    return _until(page_yield(hits), F.col("new_ok") < 1)


def stale_stop(pages: DataFrame, k: int = 3) -> DataFrame:
    """Pages (search_id, page_no, passed) kept until the k-th in a row where nothing passes."""
    w = Window.partitionBy("search_id").orderBy("page_no").rowsBetween(1 - k, 0)
    run = pages.withColumn("stale_run", F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).over(w))
    return _until(run, F.col("stale_run") == k)


#: Tables of up to so many rows are numbered by one window, group by group.
RANGE_ROWS = 1_000_000
MOST_RANGES, SAMPLES_A_RANGE = 10_000, 30


def _drawn(df: DataFrame, key: Column, chance: float, ranges: Column) -> tuple[int, str]:
    """Rows, and as JSON the sorted quantiles of a sample of key: at most `ranges` - 1 values."""
    keys = df.select(F.when(F.rand(17) < chance, key).alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("s"))
    at = F.when(ranges > 1, F.sequence(F.lit(1), ranges - 1)).otherwise(F.array().cast("array<int>"))
    picked = F.transform(at, lambda i: F.get("s", F.floor(F.size("s") * i / ranges).cast("int")))
    return tuple(keys.select("n", F.to_json(F.array_distinct(F.filter(picked, lambda x: x.isNotNull())))).first())


def _constant(df: DataFrame, key: Column, text: str) -> Column:
    return F.from_json(F.lit(text), T.ArrayType(df.select(key.alias("key")).schema["key"].dataType))


def _edges(df: DataFrame, key: Column, total: int, ranges: int) -> Column:
    """Sorted quantiles of a sample of key, as a constant array: at most `ranges` - 1 values."""
    return _constant(df, key, _drawn(df, key, min(1.0, SAMPLES_A_RANGE * ranges / total), F.lit(ranges))[1])


def _ranges(df: DataFrame, key: Column, range_rows: int) -> tuple[int, Column | None]:
    """The number of ranges and their edges: rows are counted and drawn in one pass. Only where
    MOST_RANGES cuts the number of ranges, a second pass draws at a lower chance."""
    total, text = _drawn(df, key, min(1.0, SAMPLES_A_RANGE / range_rows), F.least(F.lit(MOST_RANGES), F.ceil(F.col("n") / range_rows).cast("int")))
    if total > MOST_RANGES * range_rows:
        return MOST_RANGES, _edges(df, key, total, MOST_RANGES)
    ranges = -(-total // range_rows)
    return ranges, _constant(df, key, text) if ranges > 1 else None


def _range_number(key: Column, edges: Column, most: int) -> Column:
    """How many of the sorted edges are at most key: a binary search as a fold."""
    def step(low: Column, j: Column) -> Column:
        return F.when((low + j <= F.size(edges)) & (F.get(edges, low + j - 1) <= key), low + j).otherwise(low)

    return F.aggregate(F.array(*(F.lit(1 << j) for j in reversed(range(most.bit_length())))), F.lit(0), step)


def numbered(df: DataFrame, groups: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with `_n`, the 0-based position of each row in its group.

    A table of more than range_rows rows is cut at sampled quantiles of (groups, order), columns
    of any type, so that a group of any size spreads out and no odd value makes a large range:
    rows are numbered inside a range of their group, and the counts of the ranges before are
    added. The sample (30 rows a range, 10,000 ranges at most) is all that reaches the driver."""
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate([*groups, *order])))
    ranges, edges = _ranges(df, key, range_rows)
    if ranges <= 1:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    placed = df.withColumn("_range", _range_number(key, edges, ranges))
    own = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in groups), F.col("_range") == F.col("_c_range"))
    counts = placed.groupBy(*(F.col(g).alias(f"_c_{g}") for g in groups), F.col("_range").alias("_c_range")).agg(F.count("*").alias("_many"))
    # A row for each range of a group.
    before = Window.partitionBy(*(f"_c_{g}" for g in groups)).orderBy("_c_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_many").over(before), F.lit(0))).drop("_many")
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(base, own).select(*df.columns, (F.col("_base") + F.col("_inside")).alias("_n"))


def batches(df: DataFrame, groups: list[str], order: list[str], size: int = 24) -> DataFrame:
    """batch_no and 1-based position inside each group."""
    return numbered(df, groups, order).withColumns({"batch_no": F.floor(F.col("_n") / size), "position": (F.col("_n") % size + 1).cast("int")}).drop("_n")


def prompts(batched: DataFrame, groups: list[str]) -> DataFrame:
    """One text per batch: numbered TITLE and COMPANY lines, line feeds flattened."""
    flat = lambda c, empty: F.coalesce(X.filled(X.strip(F.regexp_replace(X.text(F.col(c)), r"[\r\n]", " "))), F.lit(empty))
    line = F.concat(F.col("position").cast("string"), F.lit(". TITLE: "), flat("title", "(no title)"), F.lit("\n   COMPANY: "), flat("company", "(unknown company)"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return batched.groupBy(*groups, "batch_no").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"), F.count("*").alias("n_rows"))
