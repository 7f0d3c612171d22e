"""Rule functions on literals whose values follow from the rules by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vacancia.functions import dates, text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("role, phrases", [("AI/ML Engineer", ["ai engineer", "ml engineer"]), ("data analyst | data scientist", ["data analyst", "data scientist"]), ("Front End/Web Dev", ["front end web dev"]), ("a, A ,", ["a"]), ("", []), ("QA/Test", ["qa test"])])
def test_role_phrases(spark, role, phrases):
    assert one(spark, X.role_phrases(F.lit(role))) == phrases


@pytest.mark.parametrize("role, query", [("AI/ML Engineer", '"AI Engineer" OR "ML Engineer"'), ("data analyst", '"data analyst"'), ("senior data analyst", "senior data analyst"), ("", "")])
def test_role_query(spark, role, query):
    assert one(spark, X.role_query(F.lit(role))) == query


@pytest.mark.parametrize("raw, iso", [("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02 10:00", "2024-01-02 00:00:00"), ("2024-01-02+05:00", None), ("soon", None), ("2024-13-45", None), ("", None), (None, None)])
def test_posted_instant(spark, raw, iso):
    got = one(spark, dates.posted_instant(F.lit(raw).cast("string")))
    assert (str(got) if got else None) == iso


@pytest.mark.parametrize("text, keep, label", [("5 minutes ago", True, "Fresh"), ("2 hours ago", True, "Fresh"), ("4 hours ago", True, "4 hours ago"), ("Reposted 2 hours ago", True, "Reposted — Reposted 2 hours ago"), ("an hour ago", True, "Fresh"), ("30 hours ago", False, ""), ("3 days ago", False, ""), ("1 week ago", False, ""), ("2 months ago", False, ""), ("", False, "")])
def test_freshness(spark, text, keep, label):
    got = one(spark, dates.freshness(F.lit(text)))
    assert (got["keep"], got["label"]) == (keep, label)


@pytest.mark.parametrize("text, keep", [("3 days ago", True), ("8 days ago", False), ("yesterday", True), ("one week ago", False)])
def test_freshness_week(spark, text, keep):
    assert one(spark, dates.freshness(F.lit(text), "week"))["keep"] is keep


@pytest.mark.parametrize("title, single", [("Data AnalystData Analyst", "Data Analyst"), ("abab", "ab"), ("Analyst with verification", "Analyst"), ("abc", "abc"), ("Nurse", "Nurse")])
def test_single_title(spark, title, single):
    assert one(spark, X.single_title(F.lit(title))) == single


@pytest.mark.parametrize("places, merged", [(["Oslo", "oslo", " Rome "], "Oslo | Rome"), (["A | B", "b"], "A | B"), (["", None], ""), (["A", "B | C", "c"], "A | B | C")])
def test_merged_locations(spark, places, merged):
    assert one(spark, X.merged_locations(F.array(*(F.lit(p).cast("string") for p in places)))) == merged


@pytest.mark.parametrize("text, phrase", [("Over 100 applicants today", "Over 100 applicants"), ("be among the first 25 applicants", "be among the first 25 applicants"), ("thank all applicants", ""), ("11 - 20 applicants", "11 - 20 applicants")])
def test_applicants(spark, text, phrase):
    assert one(spark, X.applicant_phrase(F.lit(text))) == phrase


@pytest.mark.parametrize("url, listing", [("https://boards.greenhouse.io/acme", True), ("https://boards.greenhouse.io/acme/jobs/12", False), ("https://jobs.lever.co/acme", True), ("https://jobs.ashbyhq.com/", True), ("https://x.com/careers/", True), ("https://x.com/careers?gh_jid=1", False), ("", False), (None, False)])
def test_listing(spark, url, listing):
    assert one(spark, X.is_listing_page(F.lit(url).cast("string"))) is listing


def test_relative_time(spark):
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    at = lambda s: one(spark, dates.relative_time(F.lit(s).cast("timestamp_ntz"), as_of))
    assert [at("2024-01-10 11:59:30"), at("2024-01-10 09:00:00"), at("2024-01-09 12:00:00"), at("2024-01-07 12:00:00"), at("2024-01-12 12:00:00")] == ["30 seconds ago", "3 hours ago", "yesterday", "3 days ago", "in 2 days"]
