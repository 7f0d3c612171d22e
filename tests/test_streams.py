"""The rolling window as a stream whose state ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.operators import dedup
from vacancia.streaming import streams


def test_state_ends_with_its_window(spark, tmp_path):
    """Batches in time order: the accepted rows are those of the table, and only URLs whose
    window the watermark has not passed keep state."""
    made = [(i, f"u{(i * 7) % 5 if i < 60 else 9}", f"2024-{1 + i // 20:02d}-{1 + i % 20:02d} 0{i % 7}:00:00") for i in range(80)]
    made += [(100 + i, "hot", f"2024-02-{1 + i % 20:02d} 00:00:00") for i in range(200)] + [(400, " ", "2024-01-05 00:00:00"), (401, None, "2024-01-05 00:00:00")]
    rows = spark.createDataFrame(made, "row_id long, url string, at string").select("row_id", "url", F.col("at").cast("timestamp_ntz").alias("found_at"))
    for month in (1, 2, 3, 4):
        rows.where(F.month("found_at") == month).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {r["row_id"] for r in dedup.rolling(rows, 10).select("row_id").collect()}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for late in ("1 day", None):
        folder = f"{tmp_path}/{'timed' if late else 'kept'}"
        query = streams.rolling_stream(stream, 10, late=late).writeStream.format("parquet").option("checkpointLocation", f"{folder}-check").trigger(availableNow=True).start(f"{folder}-out")
        query.awaitTermination()
        got = spark.read.parquet(f"{folder}-out")
        assert sorted(r["row_id"] for r in got.collect()) == sorted(want)
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}-check")
        urls = {r["key"]["url"] for r in state.select("key").collect()}
        assert urls == ({"u9"} if late else {"u0", "u1", "u2", "u3", "u4", "u9", "hot"})


def test_buckets_accept_what_the_table_does(spark, tmp_path):
    """Batches in any order of time within a URL's first instants, many URLs in few buckets: the
    accepted rows are those of the table, and the state has a row a bucket, not one a URL."""
    made = [(i, f"u{i % 500}" if i < 3000 else "hot", f"2024-{1 + i // 1500:02d}-{1 + i % 28:02d} 0{i % 7}:00:00") for i in range(6000)] + [(9000, " ", "2024-01-05 00:00:00"), (9001, None, "2024-01-05 00:00:00"), (9002, "x", None)]
    rows = spark.createDataFrame(made, "row_id long, url string, at string").select("row_id", "url", F.col("at").cast("timestamp_ntz").alias("found_at"))
    for month in (1, 2, 3, 4):
        rows.where((F.month("found_at") == month) | ((F.col("row_id") >= 9000) & (month == 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = sorted(r["row_id"] for r in dedup.rolling(rows, 10).select("row_id").collect())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.rolling_buckets(stream, 10, buckets=16).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted(r["row_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/check")
    assert state.count() <= 16
