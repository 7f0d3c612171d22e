"""Joins on tables that repeat addresses."""

from __future__ import annotations

from vacancia.operators import joins


def test_a_page_listed_twice_gives_its_links_once(spark):
    links = spark.createDataFrame([("p", "https://jobs.lever.co/a", "a"), ("q", "https://jobs.lever.co/b", "b")], "page_url string, url string, text string")
    template = spark.createDataFrame([("p", "board", "role", "x"), ("p", "board", "role", "x"), ("p", "board", "role", "y")], "url string, source string, search_role string, company string")
    got = {(r["url"], r["company"]) for r in joins.new_links(links, links.where("false"), template).collect()}
    assert joins.new_links(links, links.where("false"), template).count() == 2 and got == {("https://jobs.lever.co/a", "x"), ("https://jobs.lever.co/b", None)}


def test_postings_that_share_an_address_all_count_for_the_key(spark):
    columns = "url string, title string, company string, location string, posted_time string, job_description string"
    board = spark.createDataFrame([(u, t, "Acme", "Oslo", d, "", i) for u, t, d, i in (("u/1", "Cook", "2024-01-01", "1"), ("u/1", "Baker", "2024-01-02", "1"), ("u/2", "Smith", "2024-01-03", "2"), ("u/2", "Cooper", "2024-01-04", "2"))], f"{columns}, posting_id string")
    rows = spark.createDataFrame([(1, "x", "baker", "acme", "", "", "", "ats", ""), (2, "u/2", "other", "acme", "", "", "", "ats", "")], f"row_id long, {columns}, source string, apply_type string")
    got = {(r["row_id"], r["title"], r["posted_time"], r["matched"]) for r in joins.expand_boards(rows, board).collect()}
    assert got == {(1, "baker", "2024-01-02", "key"), (2, "other", "2024-01-04", "url"), (None, "Cook", "2024-01-01", "new")}
