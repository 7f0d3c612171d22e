"""Landed pages: links, embedded state, posted dates, descriptions and field patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..operators.filters import first_per
from ..operators.joins import FEW_PHRASES, matching_titles
from ..schema import ADDRESS_PARTS, CONTAINERS, META_DATES, NEXT_DATE_KEYS, PAY_KEYS
from .markup import attribute, elements, inner_html, inside


def one_per_url(pages: DataFrame, order: str = "page_id") -> DataFrame:
    return first_per(pages, ["url"], [order])


def with_pages(df: DataFrame, pages: DataFrame, order: str = "page_id") -> DataFrame:
    """df with the one page of its URL."""
    p = one_per_url(pages, order).select(F.col("url").alias("_u"), "html")
    return df.join(p, F.col("url") == F.col("_u"), "left").drop("_u")


#: An anchor: quoted or bare address, inner markup.
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:["']([^"']*)["']|([^\s"'>]+))[^>]*>(.*?)</a>"""


def links(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """Anchors of each page: id, page_url, pos, href, link (absolute), text; first per link,
    no mail, script or phone links and none to the page itself."""
    groups = (F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)).alias(n) for i, n in ((1, "quoted"), (2, "bare"), (3, "inner")))
    rows = pages.select(id_col, F.col(url).alias("page_url"), F.posexplode(F.arrays_zip(*groups)).alias("pos", "a"))
    rows = rows.select(id_col, "page_url", "pos", X.unwrapped(F.concat("a.quoted", "a.bare")).alias("href"), X.html_text(F.col("a.inner")).alias("text"))
    rows = rows.where((F.col("href") != "") & ~F.lower("href").rlike("^(mailto|javascript|tel):")).withColumn("link", X.absolute(F.col("href"), F.col("page_url")))
    bare = lambda c: F.regexp_replace(F.split_part(c, F.lit("#"), F.lit(1)), "/+$", "")
    rows = rows.where((F.col("link") != "") & (bare(F.col("link")) != bare(F.col("page_url"))))
    return first_per(rows, [id_col, "link"], ["pos"])


def kept_links(found: DataFrame, phrases: DataFrame, few: int = FEW_PHRASES) -> DataFrame:
    """Links whose address or text holds a phrase of three or more characters; each distinct
    address and text is tried once."""
    blob = F.concat_ws(" ", F.lower("href"), F.lower("text"))
    long = phrases.where(F.char_length("phrase") >= 3).select("phrase")
    held = matching_titles(found.select(blob.alias("name")).distinct(), long, few).select(F.col("name").alias("_blob")).distinct()
    return found.join(held, blob == F.col("_blob"), "left_semi")


# Classes by which cards, titles, companies, places and badges are known, in the
# order in which they count.
CARD_CLASSES = "job-card|jobs-search|entity-lockup|base-card"
TITLE_CLASSES = ("data-test-job-card-title", "job-card-list__title", "base-search-card__title")
COMPANY_CLASSES = ("primary-description", "subtitle", "company")
PLACE_CLASSES = ("metadata-item", "metadata-wrapper", "job-card-list__metadata", "bullet", "location")
BADGE_CLASSES = "easy-apply|easyapply|apply-method|footer-item"
NO_VALUE = ("", "promoted", "easy apply")


def result_rows(pages: DataFrame, base: str, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Posting rows of result lists: id, pos, url, title, company, location, job_id, apply_type.

    Every link to a job view gives a row, and so does the first link of a list item or article
    that has none. Its card is the nearest list item around it, else the nearest article, else
    the nearest block of a card's class, else its parent. Title, company and place come from the
    card's elements of known classes, then from headings, the link's text and its label
    ('Role at Company'). Of the rows of one address the first stays, its blank fields filled from
    the others in order; an easy-apply badge on any of them counts."""
    h = F.col(html)
    # Classes and addresses are cut out once an element, not at each question about it.
    classes = lambda x: F.lower(F.concat_ws(" ", attribute(x, "class"), F.regexp_extract(x["tag"], r"(?i)\s(data-test-[a-z-]+)", 1)))
    href = lambda x: F.when(x["name"] == "a", X.unwrapped(attribute(x, "href"))).otherwise("")
    found = pages.select(id_col, h.alias("_html"), elements(h).alias("_elements"))
    known = F.transform("_elements", lambda x: F.struct(*(x[c].alias(c) for c in ("name", "tag", "start", "inner", "stop", "end", "parent")), classes(x).alias("classes"), href(x).alias("href")))
    found = found.select(id_col, "_html", known.alias("_all"))
    found = found.withColumn("_anchors", F.filter("_all", lambda x: x["href"] != ""))
    rows = found.select("*", F.posexplode("_anchors").alias("pos", "_a"))

    def nearest(test) -> Column:
        """The innermost element around the link that passes the test."""
        return F.try_element_at(F.filter("_all", lambda x: test(x) & inside(F.col("_a"), x)), F.lit(-1))

    is_block = lambda x: (x["name"] == "div") & x["classes"].rlike(CARD_CLASSES)
    rows = rows.withColumn("_listed", F.coalesce(nearest(lambda x: x["name"] == "li"), nearest(lambda x: x["name"] == "article")))
    parent = F.when(F.col("_a.parent") >= 0, F.get("_all", F.col("_a.parent")))
    rows = rows.withColumn("_card", F.coalesce("_listed", nearest(is_block), parent, F.get("_all", F.array_position(F.transform("_all", lambda x: x["start"]), F.col("_a.start")).cast("int") - 1)))
    view = lambda x: F.contains(x["href"], F.lit("/jobs/view/"))
    mine = F.filter("_anchors", lambda x: inside(x, F.col("_card")))
    first = F.col("_listed").isNotNull() & ~F.exists(mine, view) & (F.get(mine, F.lit(0))["start"] == F.col("_a.start"))
    rows = rows.where(view(F.col("_a")) | first)
    rows = rows.withColumn("_inside", F.filter("_all", lambda x: inside(x, F.col("_card")))).drop("_all", "_anchors")
    value = lambda x: X.html_text(inner_html(F.col("_html"), x))
    good = lambda v: ~F.lower(v).isin(*NO_VALUE)

    def by_class(*names: str, keep=lambda v: F.lit(True)) -> Column:
        """The first filled text among the card's elements of these classes, by class."""
        def first_of(name: str) -> Column:
            of_class = F.filter("_inside", lambda x: F.contains(x["classes"], F.lit(name)))
            return F.get(F.filter(F.transform(of_class, value), lambda v: good(v) & keep(v)), F.lit(0))

        return F.coalesce(*map(first_of, names))

    text, label = value(F.col("_a")), F.regexp_replace(X.strip(attribute(F.col("_a"), "aria-label")), r"(?i)\s+with verification\s*$", "")
    heads = F.filter(F.transform(F.filter("_inside", lambda x: x["name"].rlike("^h[1-6]$")), value), lambda v: v != "")
    split = F.regexp_extract(label, r"(?s)^(.+) at (.*)$", 1)
    rows = rows.withColumns({"_text": text, "_heads": heads, "_label": F.coalesce(F.nullif(X.strip(split), F.lit("")), label), "_firm": X.strip(F.regexp_extract(label, r"(?s)^(.+) at (.*)$", 2))})
    places = ",|remote|on-?site|hybrid"
    rows = rows.withColumns({
        "_title": F.coalesce(by_class(*TITLE_CLASSES), F.get("_heads", F.lit(0)), X.filled(F.col("_text")), F.regexp_replace("_label", r"(?i)\s+with verification\s*$", "")),
        "_company": F.coalesce(by_class(*COMPANY_CLASSES), X.filled(F.col("_firm")), F.get(F.filter("_heads", lambda v: good(v)), F.lit(1)), F.lit("")),
        "_place": F.coalesce(by_class(*PLACE_CLASSES, keep=lambda v: F.lower(v).rlike(places)), by_class("metadata-item", "location"), F.lit("")),
        "_easy": F.exists(F.transform(F.filter("_inside", lambda x: x["classes"].rlike(BADGE_CLASSES)), value), lambda v: F.contains(F.lower(v), F.lit("easy apply")) & (F.char_length(v) <= 120)),
    })
    address = F.col("_a.href")
    url = F.coalesce(X.filled(X.canonical_job_url(address, base)), X.absolute(address, F.lit(base)))
    made = rows.select(id_col, "pos", url.alias("url"), X.single_title(F.col("_title")).alias("title"), F.col("_company").alias("company"), F.col("_place").alias("location"), X.job_view_id(url).alias("job_id"), F.when(F.col("_easy"), "easy_apply").otherwise("external").alias("apply_type"))
    made = made.where("title <> '' and url <> ''")
    filled = {c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("pos"))), F.lit("")) for c in ("company", "location", "job_id")}
    merged = made.groupBy(id_col, "url").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), *(v.alias(c) for c, v in filled.items()), F.bool_or(F.col("apply_type") == "easy_apply").alias("_easy"))
    return merged.select(id_col, "pos", "url", "title", "company", "location", "job_id", F.when(F.col("_easy"), "easy_apply").otherwise("external").alias("apply_type"))


# Embedded state: scripts are cut out by patterns and read as VARIANT. `with_state` does that
# once for a page and keeps the results as columns; the extractors below read these.

def script_json(html: Column, marker: str) -> Column:
    """VARIANT of the JSON assigned after marker, up to the closing script tag."""
    raw = F.regexp_extract(html, marker + r"\s*=\s*([\s\S]*?)</script>", 1)
    return F.try_parse_json(F.regexp_replace(X.strip(raw), r";\s*$", ""))


def next_text(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>([\s\S]*?)</script>""", 1)


def ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<script[^>]*ld\+json[^>]*>([\s\S]*?)</script>"""), F.lit(1))


def get(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(X.strip(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths))


def items(v: Column, path: str = "$") -> Column:
    """The elements of a JSON list, else an empty array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def job_post(remix: Column) -> Column:
    """The jobPost object of a remix page's state: that of the first route that has one."""
    found = []
    for top in ("$.state.loaderData", "$.loaderData"):
        routes = F.map_values(F.try_variant_get(remix, top, "map<string,variant>"))
        found.append(F.get(F.filter(F.transform(routes, lambda x: F.try_variant_get(x, "$.jobPost", "variant")), lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*found)


def ld_postings(html: Column) -> Column:
    """The JobPostings (array of VARIANT) of the JSON-LD blocks: at the top, in a list of any
    length, or in a @graph of either."""
    def inside(block: Column) -> Column:
        v = F.try_parse_json(block)
        top = F.concat(F.array(v), items(v))
        return F.flatten(F.transform(top, lambda x: F.concat(F.array(x), items(x, "$['@graph']"))))

    def is_posting(x: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(x, "$['@type']", "string"), F.to_json(F.try_variant_get(x, "$['@type']", "variant")), F.lit(""))
        return F.contains(kind, F.lit("JobPosting"))

    return F.filter(F.flatten(F.transform(ld_blocks(html), inside)), is_posting)


def with_state(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `_lds` (its JSON-LD postings), `_ld`, `_job`, `_posting` (VARIANT: the first of
    them, remix jobPost, app data posting) and `_next` (text), null where a page has none. Each script is cut out and
    parsed once, and only on pages that hold its marker; the steps are columns of their own,
    so that the optimiser does not repeat them for each use."""
    h = F.col(html)
    has = lambda marker, c: F.when(F.contains(h, F.lit(marker)), c)
    found = pages.withColumns({"_lds": F.when(F.contains(F.lower(h), F.lit("ld+json")), ld_postings(h)), "_remix": has("__remixContext", script_json(h, r"window\.__remixContext")), "_app": has("__appData", script_json(h, r"window\.__appData")), "_next": has("__NEXT_DATA__", next_text(h))})
    return found.withColumns({"_ld": F.get("_lds", F.lit(0)), "_job": F.when(F.col("_remix").isNotNull(), job_post(F.col("_remix"))), "_posting": F.try_variant_get("_app", "$.posting", "variant")}).drop("_remix", "_app")


STATE = ("_lds", "_ld", "_job", "_posting", "_next")


def _iso(value: Column) -> Column:
    """value, null where it does not begin with a calendar date."""
    return F.nullif(F.regexp_extract(value, r"^(\s*\d{4}-\d{2}-\d{2}[\s\S]*)$", 1), F.lit(""))


def _quoted(html: Column, low: Column, *keys: str) -> Column:
    """The date under the first of these keys that has one; low is html in lower case."""
    return F.coalesce(*(F.when(F.contains(low, F.lit(f'"{k.lower()}"')), _iso(F.regexp_extract(html, rf'(?i)"{k}"\s*:\s*"([^"]+)"', 1))) for k in keys))


def meta_content(html: Column, prop: str) -> Column:
    """Content of the first meta tag of that property or name, attributes in any order."""
    tag = F.regexp_extract(html, rf"""(?i)(<meta\b[^>]*\b(?:property|name)=["']{prop}["'][^>]*>)""", 1)
    return F.nullif(X.strip(F.regexp_extract(tag, r"""(?i)\bcontent=["']([^"']*)["']""", 1)), F.lit(""))


def next_date(text: Column) -> Column:
    """The date under the first known key, by priority, at any depth of the page's state."""
    pair = rf'(?i)"({"|".join(NEXT_DATE_KEYS)})"\s*:\s*"(\s*\d{{4}}-\d{{2}}-\d{{2}}[^"]*)"'
    names, values = (F.regexp_extract_all(text, F.lit(pair), F.lit(i)) for i in (1, 2))
    order = F.array(*map(F.lit, NEXT_DATE_KEYS))
    found = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x, i: F.struct(F.array_position(order, F.lower(x["k"])).alias("rank"), i.alias("at"), x["v"].alias("v")))
    return F.when(F.try_parse_json(text).isNotNull(), F.array_min(found)["v"])


#: How much of a page's visible text is searched for dates, and for dates near a key word.
VISIBLE, HEAD = 150_000, 40_000


def visible_text(html: Column) -> Column:
    return F.substring(X.html_text(html), 1, VISIBLE)


# The patterns of dates in visible text, the words that make a date count and how
# far from it they may stand. The range from the full stop to the dash is meant as one.
LABELLED = r"(?i)(?:posted|published|posting\s+date|date\s+posted|job\s+posted)\s*[:#\s,.-–—]*(\d{4}-\d{2}-\d{2})"
DAY = r"(?<![\p{L}\p{N}_])20[12]\d-\d{2}-\d{2}(?![\p{L}\p{N}_])"
NEAR = "(?i)posted|published|publish|date|listing|opening|job"
BEFORE, AFTER = 100, 60


def first_parsed(values: Column) -> Column:
    """The first of an array of texts that is a date."""
    return F.get(F.filter(F.transform(values, dates.posted_text), lambda x: x.isNotNull()), F.lit(0))


def near_date(head: Column) -> Column:
    """The first date of a text that parses and has one of the words around it, in one pass over
    the dates and the texts between them."""
    found, between = F.regexp_extract_all(head, F.lit(f"({DAY})"), F.lit(1)), F.split(head, DAY, -1)

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["before"])
        start = F.greatest(at - BEFORE, F.lit(0))
        around = F.substring(head, start + 1, at + F.char_length(x["day"]) + AFTER - start)
        value = F.coalesce(state["value"], F.when(around.rlike(NEAR), dates.posted_text(x["day"])))
        return F.struct((at + F.char_length(x["day"])).alias("at"), value.alias("value"))

    pairs = F.arrays_zip(found.alias("day"), F.slice(between, F.lit(1), F.size(found)).alias("before"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("value")), step)["value"]


def state_dates(html: Column, host: Column) -> dict[str, Column]:
    """Named date extractors of a page's embedded state, in order; those of a platform are null on
    other hosts. They read the columns of with_state. Of several JSON-LD postings the first that
    has a date counts."""
    lds, job, next_state = (F.col(c) for c in ("_lds", "_job", "_next"))
    updated = _iso(F.regexp_extract(html, r'(?is)"posting"\s*:\s*\{.{0,280000}?"updatedAt"\s*:\s*"([^"]+)"', 1))
    posted = F.filter(F.transform(lds, lambda x: get(x, "$.datePosted", "$.dateposted")), lambda x: x.isNotNull())
    return {
        "ashby_state": _on(host, "ashbyhq.com", F.coalesce(F.when(F.contains(html, F.lit('"posting"')), updated), _quoted(html, F.lower(html), "publishedDate"))),
        "json_ld": F.get(posted, F.lit(0)),
        "remix": _on(host, "greenhouse.io", F.coalesce(F.when(job.isNotNull(), get(job, "$.published_at")), _quoted(html, F.lower(html), "published_at"))),
        "next_data": F.when(next_state.isNotNull(), next_date(next_state)),
    }


def tag_dates(html: Column, host: Column, low: Column) -> dict[str, Column]:
    """Those that come next: keys anywhere in the page and meta tags."""
    meta = (F.when(F.contains(low, F.lit(p)), _iso(meta_content(html, p))) for p in META_DATES)
    return {
        "lever_state": _on(host, "lever.co", _quoted(html, low, "listCreatedAt", "postedAt", "createdAt", "updatedAt")),
        "date_posted": _quoted(html, low, "datePosted"),
        "meta": F.when(F.contains(low, F.lit("<meta")), F.coalesce(*meta)),
    }


def visible_dates(html: Column, host: Column, low: Column, visible: Column, as_of: Column) -> dict[str, Column]:
    """The last ones, most of the page's visible text: of dates in the text the first that parses."""
    return {
        "visible_date": first_parsed(F.regexp_extract_all(visible, F.lit(LABELLED), F.lit(1))),
        "relative": F.when(F.contains(visible, F.lit("ago")), dates.relative_date(visible, as_of)),
        "near_date": X.once(F.substring(visible, 1, HEAD), near_date),
        "late": _on(host, "workable.com", _quoted(html, low, "published_at")),
    }


def _on(host: Column, domain: str, c: Column) -> Column:
    return F.when(F.contains(host, F.lit(domain)), c)


def first_dated(candidates: dict[str, Column]) -> list[Column]:
    """Each candidate as struct(posted_time, extractor), null where it does not parse."""
    named = lambda n: lambda v: F.when(v.isNotNull(), F.struct(v.alias("posted_time"), F.lit(n).alias("extractor")))
    return [X.once(dates.posted_text(c), named(n)) for n, c in candidates.items()]


def posted_dates(pages: DataFrame, as_of: str, html: str = "html", url: str = "url", needed: Column | None = None) -> DataFrame:
    """pages with posted_time and extractor: the first candidate that parses, null on pages where
    no date is `needed`. Candidates are tried one after the other, and only while none has parsed;
    host, text and values are bound once, for code that repeats them in every branch grows
    beyond what the JVM compiles. Visible text is searched up to VISIBLE characters, a limit of
    the rule itself."""
    found = pages if set(STATE) <= set(pages.columns) else with_state(pages, html)
    h, now = F.col(html), F.lit(as_of).cast("timestamp_ntz")

    def first(host: Column) -> Column:
        seen = lambda low: X.once(visible_text(h), lambda v: F.coalesce(*first_dated(visible_dates(h, host, low, v, now))))
        rest = X.once(F.lower(h), lambda low: F.coalesce(*first_dated(tag_dates(h, host, low)), seen(low)))
        return F.coalesce(*first_dated(state_dates(h, host)), rest)

    dated = X.once(X.host(F.col(url)), first)
    found = found.withColumn("_first", dated if needed is None else F.when(needed, dated))
    return found.select(*pages.columns, "_first.posted_time", "_first.extractor")


def described(pages: DataFrame, html: str = "html", most: int = 8000) -> DataFrame:
    """pages with job_description: the JSON-LD description of over 40 characters (text, or an
    object with a value), else the first container with over 120, else a meta description of
    over 60, else ''. Later places are read only where earlier ones give nothing."""
    found = pages if set(STATE) <= set(pages.columns) else with_state(pages, html)
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")
    ld = F.when(F.col("_ld").isNotNull(), X.html_text(get(F.col("_ld"), "$.description.value", "$.description")))
    found = found.withColumns({"_text": F.when(F.char_length(ld) > 40, ld)})
    found = found.withColumn("_body", F.when(F.col("_text").isNull(), body))
    for pattern in CONTAINERS:
        found = found.withColumn("_raw", F.when(F.col("_text").isNull(), X.html_text(F.regexp_extract("_body", pattern, 1))))
        found = found.withColumn("_text", F.coalesce("_text", F.when(F.char_length("_raw") > 120, F.col("_raw"))))
    found = found.withColumn("_raw", F.when(F.col("_text").isNull(), meta_content(F.col(html), "description")))
    found = found.withColumn("_text", F.coalesce("_text", F.when(F.char_length("_raw") > 60, F.col("_raw")), F.lit("")))
    return found.select(*pages.columns, X.clip(F.col("_text"), most).alias("job_description"))


def _place(v: Column, path: str) -> Column:
    """A location given as text, as an object with an address or a name, or as an address."""
    at = [f"{path}.address.{k}" for k in ADDRESS_PARTS]
    address = F.concat_ws(", ", *(get(v, p) for p in at))
    return F.coalesce(F.nullif(address, F.lit("")), get(v, f"{path}.address", f"{path}.name", path))


def ld_fields(ld: Column) -> dict[str, Column]:
    low, high = get(ld, "$.baseSalary.value.minValue", "$.baseSalary.value.value"), get(ld, "$.baseSalary.value.maxValue")
    pay = F.nullif(F.concat_ws(" – ", low, high), F.lit(""))
    kinds = F.transform(items(ld, "$.employmentType"), lambda x: X.employment_label(x.cast("string")))
    kind = get(ld, "$.employmentType")
    return {
        "title": get(ld, "$.title"), "company": get(ld, "$.hiringOrganization.name", "$.hiringOrganization"), "posted_time": get(ld, "$.datePosted"),
        "location": F.coalesce(_place(ld, "$.jobLocation[0]"), _place(ld, "$.jobLocation")),
        "salary": F.coalesce(F.when(pay.isNotNull(), F.concat_ws(" ", pay, get(ld, "$.baseSalary.currency"))), get(ld, "$.baseSalary")),
        "employment_type": F.coalesce(F.nullif(F.array_join(kinds, ", "), F.lit("")), F.when(kind.isNotNull(), X.employment_label(kind))),
    }


def state_fields(job: Column, posting: Column) -> dict[str, Column]:
    kind = get(posting, "$.employmentType")
    return {
        "title": F.coalesce(get(job, "$.title"), get(posting, "$.title")), "company": get(job, "$.company_name"),
        "posted_time": F.coalesce(get(job, "$.published_at"), get(posting, "$.updatedAt"), get(posting, "$.publishedDate")),
        "location": F.coalesce(get(job, "$.job_post_location.name", "$.job_post_location"), get(posting, "$.locationName")), "salary": F.coalesce(get(job, *(f"$.{k}" for k in PAY_KEYS)), get(posting, "$.compensationTierSummary")),
        "employment_type": F.when(kind.isNotNull(), X.employment_label(kind)),
    }


PATCH = ("title", "company", "posted_time", "location", "salary", "employment_type")


def page_patches(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), prefix: str = "") -> DataFrame:
    """Field patch of each page: embedded state first, JSON-LD where that has nothing."""
    found = pages if set(STATE) <= set(pages.columns) else with_state(pages, html)
    some = F.col("_job").isNotNull() | F.col("_posting").isNotNull()
    state, ld = state_fields(F.col("_job"), F.col("_posting")), ld_fields(F.col("_ld"))
    raw = found.select(*keep, *(F.when(some, state[c]).alias(f"_s_{c}") for c in PATCH), *(F.when(F.col("_ld").isNotNull(), ld[c]).alias(f"_l_{c}") for c in PATCH))
    value = {c: (F.col(f"_s_{c}"), F.col(f"_l_{c}")) for c in PATCH}
    value["posted_time"] = tuple(dates.posted_text(c) for c in value["posted_time"])
    return raw.select(*keep, *(F.coalesce(*value[c], F.lit("")).alias(prefix + c) for c in PATCH))


def board_tokens(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, pos, token: board tokens of each page in order, without stop words."""
    api = F.regexp_extract_all(html, F.lit(r"(?i)boards-api\.greenhouse\.io/v1/boards/([a-zA-Z0-9_-]+)"), F.lit(1))
    board = F.regexp_extract_all(html, F.lit(r"""(?i)(?:job-boards|boards)\.greenhouse\.io/([a-zA-Z0-9_-]+)(?:/|\?|"|'|\s|$)"""), F.lit(1))
    tokens = F.filter(F.array_distinct(F.concat(api, board)), lambda t: ~F.lower(t).isin("embed", "v1", "api"))
    return pages.select(id_col, F.posexplode(tokens).alias("pos", "token"))


def enrich(df: DataFrame, pages: DataFrame, as_of: str) -> DataFrame:
    """Fill rows from their pages: patches of embedded state overwrite, then the date
    cascade and the description fill what is still blank; extractor says what gave the date.
    Pages are read once and joined once, and the cascade is left out where the patch has a date."""
    one = with_state(one_per_url(pages))
    found = page_patches(one, keep=tuple(one.columns), prefix="_p_")
    found = described(posted_dates(found, as_of, needed=X.is_blank(F.col("_p_posted_time"))))
    found = found.select(F.col("url").alias("_u"), F.col("posted_time").alias("_pt"), F.col("job_description").alias("_jd"), F.col("extractor").alias("_ex"), *(f"_p_{c}" for c in PATCH))
    joined = df.join(found, F.col("url") == F.col("_u"), "left")
    patched = joined.withColumns({c: F.coalesce(X.filled(F.col(f"_p_{c}")), X.filled(F.col(c)), F.lit("")) for c in ("posted_time", "location", "salary", "employment_type")})
    blank = F.col("posted_time") == ""
    out = {"extractor": F.when(~blank, "state").otherwise(F.col("_ex")), "posted_time": F.coalesce(F.nullif("posted_time", F.lit("")), F.col("_pt"), F.lit("")), "job_description": F.coalesce(X.filled(F.col("job_description")), F.col("_jd"), F.lit(""))}
    return patched.withColumns(out).select(*df.columns, "extractor")
