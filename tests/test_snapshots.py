"""The history as snapshots, and reads that are pruned by day."""

from __future__ import annotations

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vacancia.operators import filters, joins, stats
from vacancia.plans import pipeline
from vacancia.schema import Params
from vacancia.sources import history
from vacancia.sources.snapshots import PROBES, Conflict, Snapshots, block_and_bits, has_bit, words_of

AS_OF = "2024-03-20 12:00:00"
SCHEMA = "row_id long, title string, company string, url string, source string, search_role string, found_at timestamp_ntz"


def rows(spark, start: int, n: int, days=range(1, 21)):
    days = list(days)
    made = [(i, f"T{i % 7}", "C", f"https://x/{i % 60}", ("indeed", "ats", " ")[i % 3], (None, "dev", "")[i % 3], f"2024-03-{days[i % len(days)]:02d} {i % 24:02d}:00:00") for i in range(start, start + n)]
    return spark.createDataFrame(made, SCHEMA.replace("timestamp_ntz", "string")).withColumn("found_at", F.col("found_at").cast("timestamp_ntz"))


@pytest.fixture
def table(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/table")
    t.append(rows(spark, 0, 200), batch="a")
    t.append(rows(spark, 200, 100), batch="b")
    return t


def ids(df):
    return Counter(r["row_id"] for r in df.select("row_id").collect())


def test_versions_are_kept_apart(spark, table):
    assert table.versions() == [1, 2] and ids(table.scan(version=1)) == Counter(range(200)) and ids(table.scan()) == Counter(range(300))
    reader = table.scan()
    assert table.append(rows(spark, 300, 10), batch="c") == 10 and table.append(rows(spark, 0, 50), batch="a") == 50
    assert ids(reader) == Counter(range(300)) and ids(table.scan()) == Counter([*range(50), *range(200, 310)])
    assert table.append(rows(spark, 0, 0)) == 0 and table.clear() == 160 and table.scan().count() == 0
    assert ids(table.scan(version=2)) == Counter(range(300))
    none = Snapshots(spark, f"{table.path}-other")
    assert none.versions() == [] and none.scan().count() == 0 and none.expire(AS_OF) == 0 and none.compact() == 0 and none.newest(5).count() == 0 and none.bundle(AS_OF).count() <= 2


def test_appends_at_once_both_survive(spark, table):
    parts = [rows(spark, 1000 + 10 * i, 10) for i in range(4)]
    threads = [threading.Thread(target=Snapshots(spark, table.path).append, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert table.versions() == [1, 2, 3, 4, 5, 6] and ids(table.scan()) == Counter([*range(300), *range(1000, 1040)])


def test_a_taken_number_is_tried_again(table):
    assert not table._put(2, []) and len(ids(table.scan())) == 300
    with pytest.raises(Conflict):
        table._replace([table.parts()[0], table.parts(1)[0].__class__("gone", None, 1, 1, (), 1)], [])


@pytest.mark.parametrize("days", [5, 30, 1])
def test_retention_by_days(spark, table, days):
    table.append(rows(spark, 900, 3).withColumn("found_at", F.lit(None).cast("timestamp_ntz")), batch="null")
    before = table.scan()
    want = ids(history.retained(before, AS_OF, days))
    kept = {p for p in table.parts() if p.day and p.day > f"2024-03-{20 - min(days, 19):02d}"}
    gone = table.expire(AS_OF, days)
    assert ids(table.scan()) == want and gone == 303 - sum(want.values())
    assert kept <= set(table.parts())  # later days are the same files
    assert table.expire(AS_OF, days) == 0


def test_compaction_and_a_later_retry(spark, table):
    files = sum(p.files for p in table.parts())
    assert table.compact(least=1) > 0 and sum(p.files for p in table.parts()) < files
    assert ids(table.scan()) == Counter(range(300)) and table.compact(least=1) == 0
    table.append(rows(spark, 200, 40), batch="b")
    assert ids(table.scan()) == Counter(range(240))
    assert table.vacuum(keep=1) > 0 and ids(table.scan()) == Counter(range(240)) and len(table.versions()) == 1


def test_counts_follow_every_change(spark, table):
    same = lambda: Counter(map(tuple, table.bundle(AS_OF).collect())) == Counter(map(tuple, stats.bundle(table.scan(), AS_OF).collect()))
    assert same()
    table.append(rows(spark, 0, 70), batch="a")
    assert same()
    table.expire(AS_OF, 6)
    assert same()
    table.compact(least=1)
    assert same()


def test_newest_pages(table):
    every = [(r["found_at"], r["row_id"]) for r in table.scan().orderBy(F.desc("found_at"), F.desc("row_id")).collect()]
    page = lambda df: [(r["found_at"], r["row_id"]) for r in df.collect()]
    for limit, offset in ((5, 0), (7, 20), (50, 280), (10, 300)):
        assert page(table.newest(limit, offset)) == every[offset : offset + limit]
    at, found = 0, page(table.newest(40))
    while found:
        assert found == every[at : at + 40]
        at += 40
        found = page(table.newest_before(str(found[-1][0]), found[-1][1], 40))
    assert at >= 300
    assert len(table.newest(5).inputFiles()) < len(table.scan().inputFiles()) / 4


def test_unseen_opens_only_files_that_may_matter(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/table")
    for i in range(6):
        made = spark.range(2000).select(F.col("id").alias("row_id"), F.concat(F.lit(f"https://x/{i}/"), "id").alias("url"), F.lit(f"2024-03-{14 + i} 10:00:00").cast("timestamp_ntz").alias("found_at"))
        table.append(made.repartition(2))
    asked = spark.createDataFrame([(1, " https://x/3/77 "), (2, "https://x/none"), (3, "https://x/0/5"), (4, " "), (5, None)], "row_id long, url string")
    every = table.scan()
    for days in (3, 30):
        assert ids(table.unseen(asked, AS_OF, days)) == ids(joins.unseen(asked, every, AS_OF, days))
    files = table.files_with(asked)
    assert {r["_metadata"]["file_path"] for r in every.where("url in ('https://x/3/77', 'https://x/0/5')").select("_metadata").collect()} <= set(files)
    assert len(files) <= 3 < len(every.inputFiles()) == 6
    assert table.files_with(asked.where("row_id = 4")) == []
    strange = spark.range(4000).select(F.concat(F.lit("https://other/"), "id").alias("url"))
    kept = spark.read.parquet(f"{table.path}/blooms").where("day = '2024-03-14'")
    block, bits = block_and_bits(F.col("url"), F.lit(1))
    tested = strange.select(bits.alias("bits")).join(kept.limit(1), F.lit(True))
    hits = tested.where(" and ".join(["true"] * PROBES)).where(has_bit(F.col("words"), F.col("bits")[0]) & has_bit(F.col("words"), F.col("bits")[1]) & has_bit(F.col("words"), F.col("bits")[2]) & has_bit(F.col("words"), F.col("bits")[3])).count()
    assert hits < 0.03 * 4000


def test_bits_of_a_map(spark):
    bits = [0, 1, 7, 8, 31, 32, 100, 32767]
    one = spark.createDataFrame([(b,) for b in bits], "b long").agg(words_of(F.bitmap_construct_agg("b")).alias("words"))
    tested = one.crossJoin(spark.range(32768)).where(has_bit(F.col("words"), F.col("id"))).collect()
    assert sorted(r["id"] for r in tested) == bits


def partition_filters(df) -> list[str]:
    plan = df._jdf.queryExecution().toString()
    return [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "PartitionFilters: [" in x]


def test_reads_of_a_window_list_its_days_only(spark, tmp_path):
    path = f"{tmp_path}/history"
    history.append(rows(spark, 0, 100), path)
    stored = history.scan(spark, path)
    asked = spark.createDataFrame([(1, "T1", "C", "https://x/1", "ats")], "row_id long, title string, company string, url string, source string")
    run = pipeline.run({"ats": asked}, stored, Params(), AS_OF)
    reads = {
        "J1": joins.unseen(asked, stored, AS_OF, 7), "J2": joins.prior_url(asked, stored, AS_OF, 7), "P1": filters.history_search(stored, "ats", None, "2024-03-02", "2024-03-05"), "P3": filters.today(stored, AS_OF),
        "A3": filters.history_search(stored, date_to="2024-03-05 10:00:00").agg(F.count("*")), "A4": filters.today(stored, AS_OF).agg(F.count("*")), "E1": run, "S5": history.retained(stored, AS_OF, 3),
    }
    for name, df in reads.items():
        found = [x for x in partition_filters(df) if "found_date" in x]
        assert found and all(">= 2" in x or "<= 2" in x or ">= 1" in x or "<= 1" in x for x in found), (name, found)
    plain = stored.drop("found_date")
    for given in ({"date_from": "2024-03-03 05:00:00"}, {"date_to": "2024-03-03"}, {"date_from": "2024-03-02", "date_to": "2024-03-04 10:00:00"}):
        assert ids(filters.history_search(stored, **given)) == ids(filters.history_search(plain, **given)) != Counter()


def test_work_folders_can_be_removed(spark):
    from vacancia.plans import catalogue

    before, catalogue._made[:] = catalogue._made[:], []
    path = catalogue.work_folder(spark)
    catalogue.work_folder(spark)  # never written
    spark.range(3).write.parquet(path)
    assert catalogue.remove_work(spark) == 1 and catalogue._made == []
    catalogue._made[:] = before
