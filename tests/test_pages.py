"""Each branch of the page extractors on pages made for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vacancia.sources import pages, payloads

LONG = "word " * 40
DAY = "2024-03-05"


def made(spark, *html: str, url: str = "https://careers.example.com/jobs/1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")


def dates_of(spark, *html, url="https://careers.example.com/jobs/1"):
    got = pages.posted_dates(made(spark, *html, url=url), "2024-06-01 12:00:00")
    assert got.columns == ["page_id", "url", "html", "posted_time", "extractor"]
    return [(r["extractor"], r["posted_time"]) for r in got.orderBy("page_id").collect()]


def ld(text: str) -> str:
    return f'<script type="application/ld+json">{text}</script>'


POSTING = f'{{"@type":"JobPosting","title":"T","datePosted":"{DAY}"}}'


def test_json_ld_in_lists_and_graphs(spark):
    others = ",".join(['{"@type":"Thing"}'] * 5)
    html = [ld(POSTING), ld(f"[{others},{POSTING}]"), ld(f'{{"@graph":[{others},{POSTING}]}}'), ld(f'[{others},{{"@graph":[{others},{POSTING}]}}]'), ld("{bad json") + ld(POSTING), ld(POSTING.replace('"JobPosting"', '["Thing","JobPosting"]')), ld(others)]
    assert dates_of(spark, *html) == [("json_ld", DAY)] * 6 + [(None, None)]


def test_dates_of_embedded_state(spark):
    deep = '{"props":{"x":[{"y":{"updated_at":"2024-01-01","deep":{"first_published_at":"2024-03-05"}}}]}}'
    html = f'<script id="__NEXT_DATA__" type="application/json">{deep}</script>'
    assert dates_of(spark, html, html.replace("first_published_at", "other"), html.replace(deep, deep[:-1])) == [("next_data", DAY), ("next_data", "2024-01-01"), (None, None)]
    remix = f'<script>window.__remixContext = {{"state":{{"loaderData":{{"root":{{}},"routes/any_name":{{"jobPost":{{"published_at":"{DAY}"}}}}}}}}}};</script>'
    assert dates_of(spark, remix, '<p>"published_at": "2024-03-05"</p>', url="https://boards.greenhouse.io/x/1") == [("remix", DAY)] * 2
    ashby = [f'<script>window.__appData = {{"posting": {{"a":1,"updatedAt":"{DAY}"}}}}</script>', f'"updatedAt":"2020-01-01" "posting":{{"publishedDate":"{DAY}"}}']
    assert dates_of(spark, *ashby, url="https://jobs.ashbyhq.com/x/1") == [("ashby_state", DAY)] * 2
    assert dates_of(spark, f'"createdAt":"{DAY}"', f'"postedAt":"soon","updatedAt":"{DAY}"', url="https://jobs.lever.co/x/1") == [("lever_state", DAY)] * 2


def test_dates_of_markup_and_text(spark):
    html = [
        f'"datePosted": "{DAY}"', f'<meta content="{DAY}" property="og:published_time">', f"<meta name='date' content='{DAY}'>", f"<p>Date posted: {DAY}</p>", "<p>Posted 3 days ago</p>",
        f"<p>The opening was listed on {DAY} here</p>", f"<p>{DAY} is the day of the listing</p>", f"<p>{DAY} born</p>", '<meta property="article:published_time" content="soon">', '"datePosted": "2024-99-99"',
    ]
    assert dates_of(spark, *html) == [("date_posted", DAY), ("meta", DAY), ("meta", DAY), ("visible_date", DAY), ("relative", "2024-05-29"), ("near_date", DAY), ("near_date", DAY), (None, None), (None, None), (None, None)]
    assert dates_of(spark, '"published_at":"2024-03-05T10:00:00Z"', url="https://apply.workable.com/x") == [("late", "2024-03-05T10:00:00Z")]
    first = ld(POSTING) + '"datePosted": "2020-01-01"'
    assert dates_of(spark, first, ld(POSTING.replace(DAY, "soon")) + '"datePosted": "2020-01-01"') == [("json_ld", DAY), ("near_date", "2020-01-01")]


def test_later_dates_where_the_first_does_not_parse(spark):
    html = [
        "<p>posted 2024-13-45 and then posted 2024-03-03</p>", "<p>2024-01-01 is a listing. The job date 2024-02-02</p>", "<p>posted by Ann on 2024-03-05</p>", "<p>2024-99-01 job 2024-03-05</p>",
        ld('{"@type":"JobPosting","title":"no date"}') + ld(POSTING), ld('[{"@type":"JobPosting","datePosted":""},' + POSTING + "]"),
        "<p>job" + " x" * 60 + " 2024-03-05" + " y" * 40 + " job</p>", "<p>2024-03-05" + " y" * 29 + " job</p>", "<p>a2024-03-05 job 2024-03-056 2031-01-01</p>",
    ]
    want = [("visible_date", "2024-03-03"), ("near_date", "2024-01-01"), ("visible_date", DAY), ("near_date", DAY), ("json_ld", DAY), ("json_ld", DAY), (None, None), (None, None), (None, None)]
    assert dates_of(spark, *html) == want


def plain_visible_date(text: str):
    """The rule for dates in visible text, written out in Python; text is one line."""
    import datetime
    import re

    def parsed(day):
        try:
            return str(datetime.date.fromisoformat(day))
        except ValueError:
            return None

    for m in re.finditer(r"(?:posted|published|posting\s+date|date\s+posted|job\s+posted)\s*[:#\s,.-–—]*(\d{4}-\d{2}-\d{2})", text, re.I):
        if parsed(m.group(1)):
            return "visible_date", m.group(1)
    for m in re.finditer(r"\b(20[12]\d-\d{2}-\d{2})\b", text):
        around = text[max(0, m.start() - 100) : m.end() + 60].lower()
        if any(w in around for w in ("posted", "published", "publish", "date", "listing", "opening", "job")) and parsed(m.group(1)):
            return "near_date", m.group(1)
    return None, None


def test_visible_dates_by_a_plain_rendering(spark):
    """Texts of random parts in random order, with words near and far."""
    import random

    r = random.Random(5)
    parts = ["posted", "Published", "date posted", "job", "listing", "opening", "on", ":", "(", "-", "2024-03-05", "2024-13-45", "2019-02-30", "2031-01-01", "12024-01-02", "2024-01-023", "2023-12-31,", "x" * 58, "y " * 48, "z" * 101, "é"]
    texts = [" ".join(" ".join(r.choice(parts) for _ in range(r.randint(1, 9))).split()) for _ in range(400)]
    assert dates_of(spark, *(f"<p>{t}</p>" for t in texts)) == [plain_visible_date(t) for t in texts]


@pytest.mark.parametrize("shell", [
    '<div class="jobs-description-content__text">{}</div>', '<div class="jobs-description__text">{}</div>', '<div class="jobs-box__html-content">{}</div>', '<div class="a job-description">{}</div>', '<div class="JobDescription x">{}</div>',
    '<section id="job-description">{}</section>', '<div data-job-description="1">{}</div>', '<article class="job-description">{}</article>', '<div id="content">{}</div>', "<main>{}</main>", '<meta content="{}" name="description">',
    ld('{{"@type":"JobPosting","description":"<p>{}</p>"}}'), ld('{{"@type":"JobPosting","description":{{"value":"{}"}}}}'),
])
def test_every_place_of_a_description(spark, shell):
    got = pages.described(made(spark, shell.format(LONG), shell.format("short"))).orderBy("page_id").collect()
    assert [r["job_description"] for r in got] == [LONG.strip(), ""]


def test_patches_of_json_ld(spark):
    full = '{"@type":"JobPosting","title":"Nurse","hiringOrganization":{"name":"Acme"},"datePosted":"2024-03-05","jobLocation":[{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}],"baseSalary":{"currency":"EUR","value":{"minValue":10,"maxValue":20}},"employmentType":["FULL_TIME","Contract"]}'
    plain = '{"@type":"JobPosting","title":"Cook","hiringOrganization":"Bar","datePosted":"soon","jobLocation":"Rome","baseSalary":"much","employmentType":"part time"}'
    got = [tuple(r)[2:] for r in pages.page_patches(made(spark, ld(full), ld(plain), "none")).orderBy("page_id").collect()]
    assert got[0] == ("Nurse", "Acme", "2024-03-05", "Oslo, NO", "10 – 20 EUR", "FULL_TIME, Contract")
    assert got[1] == ("Cook", "Bar", "", "Rome", "much", "Part-time")
    assert got[2] == ("",) * 6


def test_patches_of_state_come_first(spark):
    remix = '<script>window.__remixContext = {"state":{"loaderData":{"r":{"jobPost":{"title":"S","company_name":"C","published_at":"2024-03-05","job_post_location":{"name":"L"},"salary_range":"9"}}}}};</script>'
    got = [tuple(r)[2:] for r in pages.page_patches(made(spark, remix + ld(POSTING.replace('"T"', '"T","employmentType":"contract"')))).collect()]
    assert got == [("S", "C", "2024-03-05", "L", "9", "Contract")]


def test_links_with_bare_and_quoted_addresses(spark):
    html = """<a class=x href=/a>A</a> <a href='/b c'>B</a> <a href="mailto:x@y.z">M</a><a href=//cdn.example.com/c target=_blank>C</a>"""
    got = [(r["link"], r["text"]) for r in pages.links(made(spark, html)).orderBy("pos").collect()]
    assert got == [("https://careers.example.com/a", "A"), ("https://careers.example.com/b c", "B"), ("https://cdn.example.com/c", "C")]


def test_result_rows_of_cards(spark):
    html = """<ul class="results"><li><a class="full-link" href="/jobs/view/123456?trk=abc"><h3 class="title"> Software Engineer </h3></a><h4 class="card__subtitle">Acme Corp</h4><span class="card__location">Oslo</span></li>
      <li><a href="https://x.example.com/p?id=2">Cook</a></li><li>no link</li><li><a href="/jobs/view/123456?again=1"><h3>Copy</h3></a></li></ul>"""
    got = pages.result_rows(made(spark, html), "https://www.linkedin.com").orderBy("pos").collect()
    assert [(r["url"], r["title"], r["company"], r["location"], r["job_id"]) for r in got] == [("https://www.linkedin.com/jobs/view/123456", "Software Engineer", "Acme Corp", "Oslo", "123456"), ("https://x.example.com/p?id=2", "Cook", "", "", "")]


def cards_of(spark, html):
    got = pages.result_rows(made(spark, html), "https://www.linkedin.com").orderBy("pos").collect()
    return [(r["url"].rpartition("/")[2], r["title"], r["company"], r["location"], r["apply_type"]) for r in got]


def test_result_rows_of_nested_cards(spark):
    plain = """<ul class="jobs-search__results-list"><li><a class="base-card__full-link" href="/jobs/view/123456?trk=abc"><h3 class="base-search-card__title">Software Engineer</h3></a>
      <h4 class="base-search-card__subtitle">Acme Corp</h4></li></ul>"""
    assert cards_of(spark, plain) == [("123456", "Software Engineer", "Acme Corp", "", "external")]
    nested = """<ul><li class="job-card-container"><div><a href="/jobs/view/1"><span class="job-card-list__title">Cook</span></a><span class="artdeco-entity-lockup__subtitle">Diner</span>
      <ul class="job-card-container__metadata-wrapper"><li>Promoted</li><li class="job-card-container__metadata-item">Oslo (Remote)</li></ul>
      <ul><li class="job-card-container__footer-item">Easy Apply</li></ul></div></li>
      <li><article class="job-card"><a href="/jobs/view/2" aria-label="Baker with verification at Bread &amp; Co"><img src="x"></a></article></li>
      <li><a href="/jobs/view/3">Nurse</a><ul><li>Bergen, Norway</li></ul><a href="/jobs/view/4">Second</a></li></ul>"""
    assert cards_of(spark, nested) == [("1", "Cook", "Diner", "Oslo (Remote)", "easy_apply"), ("2", "Baker", "Bread &amp; Co", "", "external"), ("3", "Nurse", "", "", "external"), ("4", "Second", "", "", "external")]
    loose = """<div class="x"><div class="promo job-card-wide"><h3>Pilot</h3><p><a href="https://www.linkedin.com/jobs/view/5?a=1">see</a></p><p class="company-name">Air</p></div></div>
      <p><a href="/jobs/view/6">Bare link</a></p><a href="/other">no job</a><script>"<li><a href='/jobs/view/7'>no</a></li>"</script><!-- <a href="/jobs/view/8">no</a> -->
      <ul><li><a href="/jobs/view/6?again">Again</a><span class="subtitle">Late Firm</span><li><a href="/jobs/view/9">Open item</a><li>rest</ul>"""
    assert cards_of(spark, loose) == [("5", "Pilot", "Air", "", "external"), ("6", "Bare link", "Late Firm", "", "external"), ("9", "Open item", "", "", "external")]


def test_balanced_elements():
    from vacancia.sources.markup import spans

    html = '<ul><li>a<ul><li>b<br></li></ul></li><li>c<p>d</ul></b><div title="a>b"/><i>é'
    got = [(e["name"], html[e["start"] : e["end"]], e["parent"]) for e in spans(html)]
    assert got == [
        ("ul", "<ul><li>a<ul><li>b<br></li></ul></li><li>c<p>d</ul>", -1), ("li", "<li>a<ul><li>b<br></li></ul></li>", 0), ("ul", "<ul><li>b<br></li></ul>", 1), ("li", "<li>b<br></li>", 2), ("br", "<br>", 3),
        ("li", "<li>c<p>d", 0), ("p", "<p>d", 5), ("div", '<div title="a>b"/>', -1), ("i", "<i>é", -1),
    ]
    assert spans("") == [] and [e["name"] for e in spans("<a" * 5000 + "<b>")] in (["b"], [], ["a"])


def test_detail_rows_with_all_lines(spark):
    text = '{"jobResult":{"jobTitle":"ML Engineer","jobLocation":"NYC","publishTime":"2026-04-04 20:58:08","publishTimeDesc":"5h ago","originalUrl":"https://example.com/jobs/1","jobId":"x","jobSummary":"Do AI","employmentType":"Full-time","jobSeniority":"Mid","salaryDesc":"$","workModel":"remote","isRemote":true,"applicantsCount":"10"},"companyResult":{"companyName":"Acme"},"displayScore":0.9}'
    snake = '{"job_result":{"job_title":"Cook","apply_link":"https://example.com/2","isRemote":false,"publish_time":"soon"},"company_result":{}}'
    df = spark.createDataFrame([(1, text), (2, snake), (3, "{}"), (4, "no json")], "id long, payload string")
    got = {r["id"]: r.asDict() for r in payloads.detail_rows(df).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one["title"], one["company"], one["url"], one["location"], one["posted_time"], one["freshness"]) == ("ML Engineer", "Acme", "https://example.com/jobs/1", "NYC", "2026-04-04T20:58:08", "5h ago")
    assert one["job_description"].split("\n") == ["Do AI", "", "Work model: remote", "Remote: true", "Jobright match score: 0.9"]
    assert (two["company"], two["location"], two["posted_time"], two["job_description"]) == ("Unknown", "Unknown", "", "Remote: false")
