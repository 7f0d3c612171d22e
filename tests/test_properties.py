"""Properties of merges, sinks and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from vacancia import fixtures
from vacancia.operators import dedup, filters, joins
from vacancia.plans.catalogue import AS_OF
from vacancia.sources import history, payloads
from vacancia.streaming import streams

from .conftest import SF


def postings(spark):
    return fixtures.view(spark, SF, "postings").dropDuplicates(["row_id"])


def test_merge_is_idempotent(spark):
    once = dedup.cross_source(postings(spark)).drop("merged_rows")
    twice = dedup.cross_source(once).drop("merged_rows")
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0


def test_rolling_windows_are_apart(spark):
    ok = dedup.rolling(postings(spark), 30)
    again = dedup.rolling(ok, 30)
    assert ok.count() == again.count()
    close = ok.alias("a").join(ok.alias("b"), (F.col("a.url") == F.col("b.url")) & (F.col("a.row_id") != F.col("b.row_id")) & (F.abs(F.unix_micros(F.col("a.found_at").cast("timestamp")) - F.unix_micros(F.col("b.found_at").cast("timestamp"))) < 30 * 86_400_000_000))
    assert close.count() == 0


def test_age_counts_add_up(spark):
    p = postings(spark)
    assert sum(filters.age_counts(p, AS_OF, 30).first()) == p.count()


def test_board_expansion_loses_nothing(spark):
    p = postings(spark)
    board = payloads.postings(fixtures.view(spark, SF, "board_payloads"), "greenhouse").withColumnRenamed("job_id", "posting_id")
    out = joins.expand_boards(p, board)
    assert out.where("matched <> 'new'").count() == p.count()


def test_empty_input(spark):
    none = postings(spark).where("false")
    assert dedup.cross_source(none).count() == dedup.rolling(none, 7).count() == 0
    assert joins.unseen(none, none, AS_OF, 7).count() == 0


def test_history_append_expire_clear(spark, tmp_path):
    p, path = postings(spark).where("source = 'yc'"), f"{tmp_path}/history"
    assert history.append(p, path) == p.count()
    assert history.append(p.limit(3), path, AS_OF) == 3
    stored = history.scan(spark, path)
    assert stored.count() == p.count() + 3
    gone = history.expire(spark, path, f"{tmp_path}/kept", AS_OF, 30)
    assert history.scan(spark, f"{tmp_path}/kept").count() == stored.count() - gone
    assert history.clear(spark, f"{tmp_path}/kept") == stored.count() - gone
    assert history.scan(spark, f"{tmp_path}/kept").count() == 0


def test_partition_pruning(spark, tmp_path):
    path = f"{tmp_path}/history"
    history.append(postings(spark).where("source = 'yc'"), path)
    few = history.scan(spark, path).where(F.col("found_date") >= F.lit("2000-01-01").cast("date"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(found_date" in plan


def test_report_export(spark, tmp_path):
    p = postings(spark).limit(20)
    assert history.export_report(p, f"{tmp_path}/report") == 20
    back = spark.read.option("header", True).csv(f"{tmp_path}/report/rows")
    assert back.count() == 20 and len(back.columns) == 14


def test_stream_counts_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.progress_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("progress").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in streams.progress_counts(events).collect()}


def test_stream_rolling_matches_batch(spark, tmp_path):
    rows = postings(spark).where("source in ('yc', 'ats')").select("row_id", "url", "found_at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streams.rolling_stream(stream, 60).writeStream.outputMode("append").format("memory").queryName("accepted").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r["row_id"] for r in spark.table("accepted").collect()} == {r["row_id"] for r in dedup.rolling(rows, 60).collect()}


def test_incremental_run(spark, tmp_path):
    postings(spark).limit(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(postings(spark).schema).parquet(f"{tmp_path}/in")
    q = streams.incremental(stream, lambda df, _: history.append(df, f"{tmp_path}/history", AS_OF), f"{tmp_path}/cp")
    q.awaitTermination()
    assert history.scan(spark, f"{tmp_path}/history").count() == 50


def test_lever_and_ashby_payloads(spark):
    lever = '[{"id":"a","text":"Nurse","categories":{"location":"Oslo"},"createdAt":1704067200000,"hostedUrl":"https://jobs.lever.co/x/a","descriptionPlain":"Care"},7,{"id":"b","text":"","hostedUrl":"u"}]'
    ashby = '{"jobs":[{"id":"c","isListed":true,"title":"Cook","location":"","publishedAt":"2024-01-05","jobUrl":"https://jobs.ashbyhq.com/x/c","descriptionHtml":"<p>Hot &amp; fast</p>"},{"id":"d","isListed":false,"title":"Chef","jobUrl":"u"}]}'
    df = spark.createDataFrame([("my-co", lever), ("my-co", ashby), ("my-co", "not json"), ("my-co", None)], "token string, payload string")
    assert [tuple(r) for r in payloads.postings(df, "lever").select("title", "company", "location", "posted_time").collect()] == [("Nurse", "My Co", "Oslo", "2024-01-01")]
    assert [tuple(r) for r in payloads.postings(df, "ashby").select("title", "location", "posted_time", "job_description").collect()] == [("Cook", "Unknown", "2024-01-05", "Hot & fast")]


