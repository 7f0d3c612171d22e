"""The postings history (a Parquet table partitioned by found_date), run log and report."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.filters import found_between, report, window_start
from ..schema import CANONICAL, POSTING

STORED = T.StructType([*POSTING.fields, T.StructField("found_date", T.DateType())])
PARTITIONS = ("found_date", "batch")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Late columns of old files read as null; filters on found_date prune partitions."""
    return _files(spark, path).drop("batch")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*STORED.fields, T.StructField("batch", T.StringType())])).parquet(path)


def scan_other_batches(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The history without one batch; empty where nothing has been stored yet."""
    try:
        return _files(spark, path).where(F.col("batch") != batch).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def canonical(df: DataFrame, source: str) -> DataFrame:
    """The 16 canonical columns; the row's own source wins over the given one. Roles and
    locations of the search keep their nulls."""
    has = set(df.columns)
    col = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    rules = {"source": F.coalesce(X.filled(col("source")), F.lit(source)), "apply_type": F.coalesce(X.filled(col("apply_type")), F.lit("unknown")), "search_role": col("search_role"), "search_location": col("search_location")}
    return df.select(*(c for c in ("row_id",) if c in has), *(rules.get(c, X.text(col(c))).alias(c) for c in CANONICAL), *(c for c in ("found_at",) if c in has))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    frames = [canonical(df, name) for name, df in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_in_one_pass(df: DataFrame, names: dict[str, str], lacking: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """union_sources where all sources lie in one table: its rows of these sources under their given
    names, read once and not once a source. Columns that a source is lacking count as missing."""
    source, lacking = F.col("source"), lacking or {}
    gone = {c: F.when(~source.isin(*(s for s in lacking if c in lacking[s])), F.col(c)) for c in {c for cs in lacking.values() for c in cs}}
    rows = df.where(source.isin(*names)).withColumns(gone | {"source": X.labelled(source, names, source)})
    return canonical(rows, "")


def to_store(df: DataFrame, found_at: str | None = None) -> DataFrame:
    """Rows as they are stored: trimmed, blank to null, one run timestamp."""
    optional = [c for c in ("location", "job_id", "posted_time", "freshness", "applicant_count", "job_description", "seniority", "salary", "employment_type") if c in df.columns]
    rows = df.where(~X.is_blank(F.col("url"))).withColumns({c: X.filled(X.strip(F.col(c))) for c in optional} | {"url": X.strip(F.col("url"))})
    if found_at:
        rows = rows.withColumn("found_at", F.lit(found_at).cast("timestamp_ntz"))
    return rows.withColumn("found_date", F.to_date("found_at"))


def by_day(df: DataFrame) -> DataFrame:
    """Rows with their found_date, those of a day brought together, a large day in several parts."""
    return df.withColumn("found_date", F.to_date("found_at")).hint("rebalance", "found_date")


def append(df: DataFrame, path: str, found_at: str | None = None, batch: str | None = None, grouped: bool = False) -> int:
    """Append rows to the history; the count comes with the write, not from a second job.
    A batch that is named and written again takes the place of its first writing, so a retry
    does not double rows. Rows of a day are brought together first, unless they come `grouped`,
    or every task would write a file of its own to every day."""
    seen = Observation("append")
    stored = to_store(df, found_at)
    rows = (stored if grouped else by_day(stored)).withColumn("batch", F.lit(batch or uuid.uuid4().hex)).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    return seen.get["n"]


def retained(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return found_between(df, since=window_start(as_of, days))


def expire(spark: SparkSession, path: str, new_path: str, as_of: str, days: int = 30) -> int:
    """Write the retained history to new_path and return how many rows were dropped. The
    old table stays until the caller swaps the paths, so a lost job loses nothing."""
    before, after = Observation("before"), Observation("after")
    old = _files(spark, path).observe(before, F.count(F.lit(1)).alias("n"))
    retained(old, as_of, days).observe(after, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(new_path)
    return before.get["n"] - after.get["n"]


def clear(spark: SparkSession, path: str) -> int:
    """Empty the history; returns the number of rows it had."""
    n = scan(spark, path).count()
    spark.createDataFrame([], STORED).write.mode("overwrite").parquet(path)
    return n


def export_report(df: DataFrame, path: str, title: str = "Job report", files: int | None = None) -> int:
    """The 14-column report as CSV files with a header each, and its total beside them. Tasks
    write their own files; files=1 makes one of a report that one task can hold."""
    seen = Observation("report")
    rows = report(df).observe(seen, F.count(F.lit(1)).alias("n"))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/rows")
    n = seen.get["n"]
    df.sparkSession.createDataFrame([(title, n)], "title string, total long").write.mode("overwrite").json(f"{path}/total")
    return n


def run_state(log: DataFrame, key: str = "run_id", order: str = "ord") -> DataFrame:
    """Current state of each run: the last non-null value of every field."""
    fields = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))


def json_list(c):
    """Array of strings from JSON text; bad or wrong-typed text gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def json_map(c):
    return F.coalesce(F.from_json(c, "map<string,boolean>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,boolean>"))
