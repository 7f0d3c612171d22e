"""Every query with an oracle gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from vacancia import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v) -> str:
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "biu" or isinstance(v, bool) else str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = pd.DataFrame({c: df[c].map(shown) for c in sorted(df.columns)})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_oracle(spark, duck, name):
    got = normal(registry.queries()[name](spark, SF).toPandas())
    want = normal(duck.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert got.equals(want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_all_registered_names_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_whole_jobs(spark, duck):
    """All documents have a location; known links take away some of all pages' links."""
    found = registry.queries()["f18_location_in_all_texts"](spark, SF)
    assert found.count() == duck.execute("SELECT count(*) FROM documents").fetchone()[0] > registry.queries()["f18_location_in_text"](spark, SF).count()
    new = registry.queries()["j12_new_links_of_all_pages"](spark, SF).toPandas()
    some = registry.queries()["j12_new_links"](spark, SF).toPandas()
    known = some["new_url"].str.len() % 3 == 0
    assert 0 < known.sum() < len(some) < len(new) + known.sum()
    assert set(some["new_url"][~known]) <= set(new["new_url"]) and not set(some["new_url"][known]) & set(new["new_url"])


def test_new_links_are_not_those_of_known_pages(spark):
    """j12_new_links leaves out the links of odd pages, and nothing else of even ones."""
    from pyspark.sql import functions as F

    from vacancia import fixtures
    from vacancia.sources import pages

    board = F.regexp_replace("link", "^https?://[^/]+", "https://jobs.lever.co").alias("new_url")
    found = pages.links(fixtures.view(spark, SF, "pages")).where("not startswith(href, '/url?')").select("page_id", "page_url", board).collect()
    even, odd = ([r for r in found if r["page_id"] % 2 == i] for i in (0, 1))
    known = {r["new_url"] for r in odd}
    got = registry.queries()["j12_new_links"](spark, SF).select("page_url", "new_url").collect()
    assert known & {r["new_url"] for r in even}
    assert sorted(map(tuple, got)) == sorted({(r["page_url"], r["new_url"]) for r in even if r["new_url"] not in known})
