"""What large tables are shuffled for, and how often."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vacancia import fixtures, registry
from vacancia.operators import dedup, filters
from vacancia.sources import history

from .conftest import SF


@pytest.fixture
def plan(spark):
    """The plan of a query where no table is small enough to be broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_orders_find_their_nation_before_items_come(spark, plan):
    lines = plan(fixtures.view(spark, SF, "postings")).splitlines()
    at = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(o_custkey" in x)
    assert "o_orderkey" in next(x for x in lines[at:] if "FileScan" in x)
    assert fixtures.view(spark, SF, "postings").exceptAll(spark.sql(fixtures.VIEWS["postings"])).count() == 0
    assert fixtures.view(spark, SF, "postings").count() == spark.sql(fixtures.VIEWS["postings"]).count()


@pytest.mark.parametrize("name", ["d1_cross_source", "d2_board_rows", "d3_in_run", "u2_removed"])
def test_items_are_dealt_once(spark, plan, name):
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1 and "ReusedExchange" in text


def test_first_of_a_key_alone_is_hashed(spark, plan):
    rows = fixtures.view(spark, SF, "postings").select("url", "row_id")
    assert "SortAggregate" not in plan(dedup.first_by_url(rows))
    assert dedup.first_by_url(rows).exceptAll(filters.first_per(rows.withColumn("x", F.lit(1)), ["url"], ["row_id"]).drop("x")).count() == 0


def test_an_append_writes_a_day_once(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.concat(F.lit("https://x/"), "id").alias("url"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") % 20)).alias("found_at"))
    assert history.append(rows.repartition(8), f"{tmp_path}/h", batch="a") == 4000
    stored = history.scan(spark, f"{tmp_path}/h")
    assert stored.count() == 4000 and len(stored.inputFiles()) == 20
    assert history.append(history.by_day(rows), f"{tmp_path}/h", batch="a", grouped=True) == 4000
    assert history.scan(spark, f"{tmp_path}/h").count() == 4000


def test_maps_hold_the_bits_of_every_url(spark, tmp_path):
    """Maps made a file at a time, with files in turn, are those of the exploded bits."""
    from vacancia.sources.snapshots import block_and_bits, maps_of

    rows = spark.range(3000).select((F.col("id") % 3).alias("f"), F.concat(F.lit("https://x/"), F.col("id") % 900).alias("url"))
    block, bits = block_and_bits(F.col("url"), F.lit(4))
    want = rows.select("f", block.alias("block"), F.explode(bits).alias("bit")).groupBy("f", "block").agg(F.bitmap_construct_agg("bit").alias("map"))
    noted = rows.select("f", block.alias("block"), F.xxhash64("url").alias("h"))
    got = noted.mapInArrow(maps_of(4), "f long, block int, map binary").groupBy("f", "block").agg(F.bitmap_or_agg("map").alias("map"))
    assert got.count() == want.count() == 12 and got.exceptAll(want).count() == 0


def test_large_text_columns_evaluate_their_argument_once(spark):
    """The argument of a split or a listing test is not repeated in every branch."""
    from vacancia.functions import dates, text as X

    rows = spark.createDataFrame([(x,) for x in ("Dev at A at B", "x at at y", " Dev @ B - C ", "a at ", "Dev", "", None, "Dev with verification at A", "at B")], "t string")
    old = [F.regexp_extract(X.strip(X.text(F.col("t"))), r"^([\s\S]+) at ([\s\S]*)$", i) for i in (1, 2)]
    whole = X.strip(X.text(F.col("t")))
    want = rows.select(X.unverified(F.when(old[0] != "", old[0]).otherwise(whole)).alias("title"), F.when(old[0] != "", X.strip(old[1])).otherwise("").alias("company")).collect()
    assert rows.select(X.split_label(F.col("t")).alias("l")).select("l.*").collect() == want
    for f in (X.split_title, X.split_label, X.is_listing_page, dates.freshness):
        assert str(f(F.reverse("t"))._jc.toString()).count("reverse(t)") == 1


def test_a_template_takes_its_own_columns_only(spark, plan):
    assert "p_type" not in plan(registry.queries()["j9_template"](spark, SF))


def test_the_date_cascade_is_code_that_the_jvm_compiles(spark, plan):
    """A date binds its argument once, and no whole-stage method of the cascade or of the patches
    has more than the 8,000 bytes of code up to which the JVM compiles it."""
    from vacancia.functions import dates
    from vacancia.sources import pages

    assert str(dates.posted_text(F.reverse("t"))._jc.toString()).count("reverse(t)") == 1
    texts = ("2024-03-01", " 2024-03-01T08:30:00Z ", "2024-03-01T08:30+02:00", "2024-13-45", "2024-03-01 and more", "2024-03-01+02:00", "2024-03-01T", "x 2024-03-01", "Then 2024", "", None, "2024-03-01T08:30:00.123&amp;", "2024-02-30T10:00:00Z")
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    trimmed = dates.trimmed_date(F.col("t"))
    assert rows.select(dates.posted_text(F.col("t"))).collect() == rows.select(F.when(dates.posted_instant(trimmed).isNotNull(), trimmed)).collect()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    p = fixtures.view(spark, SF, "job_pages")
    for df in (pages.posted_dates(p, "2000-01-01 12:00:00").select("page_id", "posted_time", "extractor"), pages.page_patches(p).select("page_id", "posted_time")):
        code = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000


def test_a_patched_page_is_not_searched_for_a_date(spark):
    from vacancia.sources import pages

    old, new = ('<script type="application/ld+json">{"@type":"JobPosting","datePosted":"2024-01-02"}</script>', "<p>Posted 2024-03-04</p>")
    made = spark.createDataFrame([(1, "https://x/1", old), (2, "https://x/2", new), (3, "https://x/3", old + new)], "page_id int, url string, html string")
    got = pages.posted_dates(made, "2024-06-01 12:00:00", needed=F.col("page_id") != 1).select("page_id", "posted_time", "extractor").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, "2024-03-04", "visible_date"), (3, "2024-01-02", "json_ld")]
    blank = made.select(F.col("page_id").alias("row_id"), "url", *(F.lit("").alias(c) for c in ("title", "company", "posted_time", "location", "salary", "employment_type", "job_description")))
    got = pages.enrich(blank, made, "2024-06-01 12:00:00").select("row_id", "posted_time", "extractor").orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, "2024-01-02", "state"), (2, "2024-03-04", "visible_date"), (3, "2024-01-02", "state")]


@pytest.mark.parametrize("name", ["s3_union_sources", "s3_union_of_all_sources"])
def test_a_union_of_one_table_reads_it_once(spark, plan, name):
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning(l_orderkey") == text.count("FileScan parquet [l_orderkey") == 1
    assert "ShuffledHashJoin [l_orderkey" in text


def test_a_union_in_one_pass_is_that_of_its_sources(spark):
    p = fixtures.view(spark, SF, "postings")
    want = history.union_sources({"linkedin": p.where("source = 'linkedin'"), "indeed": p.where("source = 'indeed'"), "board": p.where("source = 'ats'").drop("source", "salary")})
    got = history.union_in_one_pass(p, {"linkedin": "linkedin", "indeed": "indeed", "ats": "board"}, {"ats": ("salary",)})
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and got.where("source = 'board' and salary <> ''").count() == 0


@pytest.mark.parametrize("name", ["d1_cross_source", "d2_board_rows", "d3_in_run"])
def test_a_merge_shuffles_its_rows_once(spark, plan, name):
    """By the bucket of title and company, after the joins; joins of d1 sort no items."""
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning(_") == text.count("Exchange hashpartitioning(_b") == 1
    assert name != "d1_cross_source" or text.count("SortMergeJoin [l_orderkey") == text.count("SortMergeJoin [l_partkey") == 0


def made_postings(spark, n: int, titles: int):
    """Postings of a few titles, every row with its own mixture of blank fields and odd characters."""
    rows = [(i, f"{('Dev', ' dev', 'DEV')[i % 3]}{i % titles}{' ' * (i % 4)}", ("Acme", " ACME")[i % 2] if i % 17 else None, f"u/{i}", (f"City {i * i % 11}", f"city {i % 5} ", "", None, "a\x01b\x02a\x02")[i % 5], *((None, "", " ", f"{c}\x01{i}\x02", f"{c}{'x' * (i * 7 % 13)}")[(i * 31 + 7 * j + i // 50) % 97 % 5 if i > 40 else 0] for j, c in enumerate(dedup.FILL))) for i in range(n)]
    return spark.createDataFrame([rows[i * 37 % n] for i in range(n)], f"row_id long, title string, company string, url string, location string, {', '.join(f'{c} string' for c in dedup.FILL)}")


@pytest.mark.parametrize("titles", [1, 400])
def test_a_title_sends_what_its_merge_may_take(spark, titles):
    """A merge is that of rows in order by brute force, and a hot title sends few of its rows."""
    from vacancia.functions import text as X

    made = made_postings(spark, 1999, titles)
    groups, want = {}, []
    blank = lambda v: not (v or "").strip()
    for r in sorted(made.collect(), key=lambda r: r["row_id"]):
        if r["company"] is None:
            want.append((*r, 1))
        else:
            groups.setdefault(r["title"].strip().lower(), []).append(r)
    for rows in groups.values():
        rich = {r["row_id"]: sum(w for c, w in zip(dedup.FILL, (100, 10, 1, 1, 1)) if not blank(r[c])) for r in rows}
        best = max(rows, key=lambda r: (rich[r["row_id"]], -r["row_id"]))
        out = best.asDict()
        if len(rows) > 1:
            places = []
            for r in rows:
                if not blank(r["location"]) and r["location"].strip().lower() not in [x.lower() for x in places]:
                    places.append(r["location"].strip())
            out["location"] = " | ".join(places)
            out |= {c: next((r[c] for r in rows if not blank(r[c])), best[c]) for c in dedup.FILL if blank(best[c])}
        want.append((*out.values(), len(rows)))
    got = [tuple(r) for r in dedup.cross_source(made).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    keyed = made.withColumns({c: X.key(F.col(c)) for c in ("title", "company")})
    assert sorted((r[0], *r[3:]) for r in map(tuple, dedup.cross_source(keyed, keyed=True).fillna("~").collect())) == sorted((r[0], *r[3:]) for r in map(tuple, dedup.cross_source(made).fillna("~").collect()))
    picks = {"_row": (dedup.richness(), F.lit(True), "*")}
    sent = made.where("company is not null").select((F.col("row_id") % 3).cast("int").alias("_b"), X.key(F.col("title")).alias("_t"), F.lit("a").alias("_c"), F.lit(1).cast("long").alias("_n"), F.lit(-1).cast("long").alias("_may"), "row_id", "location", "url", X.strip(X.text(F.col("location"))).alias("_where"), picks["_row"][0].alias("_row"))
    texts, others = ["_t", "_c", "location", "url"], ["_n", "_may", "row_id"]
    slices = sent.coalesce(1).mapInArrow(dedup._thinned({"_row": (True, "*")}, "row_id", [*texts, *others]), f"_b int, {', '.join(f'{n} string' for n in texts)}, {', '.join(f'{n} array<long>' for n in others)}")
    left = dedup.unpacked(slices, texts, others, ["_b"]).withColumn("_where", X.strip(X.text(F.col("location"))))
    assert slices.count() <= 3
    assert left.agg(F.sum("_n")).first()[0] == sent.count() and left.where("_may <> 0").select("_t").distinct().count() == left.where("_may <> 0").count() == titles
    assert left.select("_t", "_where").distinct().count() == sent.select("_t", "_where").distinct().count() and left.where("_may = 0 and url is not null").count() == 0


def test_packed_rows_are_those_unpacked(spark):
    import numpy as np
    import pyarrow as pa

    values = ["", " ", None, "a", "\x01", "\x02", "\x02a", "\x02b\x01\x01", "\x01\x02", "\n", "\u00e9\U0001f600"]
    pairs = [(a, b) for a in values for b in values]
    offsets = np.array([0, 1, 2, 3, 40, len(pairs)])
    a, b, i = (dedup.packed(pa.array(x), offsets) for x in ([a for a, _ in pairs], [b for _, b in pairs], [None if i % 7 == 1 else i for i in range(len(pairs))]))
    df = spark.createDataFrame(list(zip(a.to_pylist(), b.to_pylist(), i.to_pylist(), range(5))), "a string, b string, i array<long>, k int")
    got = dedup.unpacked(df, ["a", "b"], ["i"], ["k"]).collect()
    assert [(r["a"], r["b"], r["i"]) for r in sorted(got, key=lambda r: r["k"])] == [(a, b, None if i % 7 == 1 else i) for i, (a, b) in enumerate(pairs)]
    assert [r["k"] for r in got] == [k for k in range(5) for _ in range(offsets[k], offsets[k + 1])]
