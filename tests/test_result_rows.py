"""Work of result pages."""

from __future__ import annotations

from contextlib import redirect_stdout
from io import StringIO

from vacancia.sources import pages


def test_classes_are_cut_out_once_an_element(spark):
    """The pattern of a class is in the plan for the elements, not at each class looked for."""
    html = '<ul><li><a href="/jobs/view/7?x=1"><h3>Cook</h3></a><h4 class="card__subtitle">Acme</h4><span class="card__location">Oslo, Norway</span></li></ul>'
    found = pages.result_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "https://www.linkedin.com")
    assert [tuple(r) for r in found.select("page_id", "title", "company", "location", "job_id").collect()] == [(1, "Cook", "Acme", "Oslo, Norway", "7")]
    text = StringIO()
    with redirect_stdout(text):
        found.explain()
    assert 0 < text.getvalue().count("data-test-[a-z-]+") <= 4
