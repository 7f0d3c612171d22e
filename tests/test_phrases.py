"""Many phrases at once: joined by their rarest part, as if each were tried."""

from __future__ import annotations

import random

from vacancia.operators import joins
from vacancia.sources import pages


def test_many_phrases_equal_each_tried(spark):
    r = random.Random(3)
    words = ["senior", "engineer", "data", "ab", "é", "x", "scientist", "lead", "eng"]
    titles = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(200)})
    phrases = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 3)))[: r.randint(1, 20)] for _ in range(300)} | {"senior", "no such", "", "eng"})
    t, p = spark.createDataFrame([(x,) for x in titles], "name string"), spark.createDataFrame([(x,) for x in phrases], "phrase string")
    want = {(x, y) for x in titles for y in phrases if y and y in x}
    for few in (2000, 0):
        got = joins.matching_titles(t, p, few).collect()
        assert len(got) == len(want) and {(x["name"], x["phrase"]) for x in got} == want
    plan = joins.matching_titles(t, p.where("length(phrase) > 2"), 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # the phrases of one or two characters


def test_links_kept_by_many_phrases(spark):
    links = spark.createDataFrame([(1, "/jobs/Data-1", "Data Engineer"), (2, "/about", "About us"), (3, "/x", "our data team"), (3, "/x", "our data team"), (4, "/senior", None), (5, "/ab", "ab")], "id int, href string, text string")
    phrases = spark.createDataFrame([("data",), ("senior",), ("ab",), ("engineer",)], "phrase string")
    for few in (2000, 0):
        assert sorted(r["id"] for r in pages.kept_links(links, phrases, few).collect()) == [1, 3, 3, 4]
