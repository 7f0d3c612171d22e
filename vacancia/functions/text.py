"""Text, URL and phrase functions on columns. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_PHRASES, EMPLOYMENT_LABELS, GENERIC_LOCATIONS, LISTING_SUFFIXES, PLATFORM_HOSTS

SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(strip(c.cast("string")) != "", c)


def is_blank(c: Column) -> Column:
    return strip(text(c)) == ""


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(filled(c) for c in columns), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def normal(c: Column) -> Column:
    return collapse(F.lower(text(c)))


def key(c: Column) -> Column:
    return F.lower(strip(text(c)))


def once(c: Column, f) -> Column:
    """f(c), with c evaluated once however often f refers to it. Large columns are written with
    it, whose code would else repeat their argument in every branch."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def labelled(c: Column, labels: dict[str, str], otherwise: Column) -> Column:
    """Look c up in a fixed table."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(labels.items())[1:], F.when(c == next(iter(labels)), labels[next(iter(labels))])).otherwise(otherwise)


# URLs.

def host(url: Column) -> Column:
    return F.lower(text(F.try_parse_url(strip(text(url)), F.lit("HOST"))))


def path(url: Column) -> Column:
    return text(F.try_parse_url(strip(text(url)), F.lit("PATH")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def query_value(url: Column, name: str) -> Column:
    return text(F.try_parse_url(strip(text(url)), F.lit("QUERY"), F.lit(name)))


def platform(url: Column) -> Column:
    """Platform of a host that is one of the known suffixes or below it."""
    h = host(url)
    tests = [(h == s) | F.endswith(h, F.lit("." + s)) for s in PLATFORM_HOSTS]
    return reduce(lambda w, x: w.when(*x), list(zip(tests, PLATFORM_HOSTS.values()))[1:], F.when(tests[0], next(iter(PLATFORM_HOSTS.values())))).otherwise("")


def board_slug(url: Column, domain: str) -> Column:
    return F.when(F.contains(host(url), F.lit(domain)), F.lower(text(F.get(segments(url), F.lit(0))))).otherwise("")


def company_from_slug(slug: Column) -> Column:
    return F.initcap(F.translate(text(slug), "-_", "  "))


def company_from_url(url: Column) -> Column:
    known = reduce(lambda a, b: a | b, (F.contains(host(url), F.lit(s)) for s in PLATFORM_HOSTS))
    return F.when(known, company_from_slug(F.get(segments(url), F.lit(0)))).otherwise("")


def embedded_job_id(url: Column) -> Column:
    """Digits of gh_jid in the query or the path, else ''."""
    u = strip(text(url))
    return F.coalesce(F.when(query_value(u, "gh_jid").rlike(r"^\d+$"), query_value(u, "gh_jid")), F.nullif(F.regexp_extract(u, r"(?i)[?&]gh_jid=(\d+)", 1), F.lit("")), F.regexp_extract(path(u), r"(?i)/gh_jid[/=](\d+)", 1))


def greenhouse_listing(url: Column) -> Column:
    h, s = host(url), segments(url)
    board = F.contains(h, F.lit("greenhouse.io")) & (F.contains(h, F.lit("job-boards")) | F.contains(h, F.lit("boards.greenhouse")))
    return board & ~F.lower(path(url)).rlike(r"/jobs/\d+") & ((F.size(s) == 1) | ((F.size(s) == 2) & (F.lower(F.get(s, F.lit(1))) == "jobs")))


def is_listing_page(url: Column) -> Column:
    """A board's index rather than one posting."""

    def test(u: Column, h: Column, whole: Column) -> Column:
        s = F.filter(F.split(whole, "/"), lambda x: x != "")
        p = F.lower(F.regexp_replace(whole, "/+$", ""))
        single = (query_value(u, "gh_jid") != "") | text(u).rlike(r"(?i)[?&]gh_jid=\d+") | whole.rlike(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}") | p.rlike(r"/jobs/\d+(/|$)")
        suffix = reduce(lambda a, b: a | b, (F.endswith(p, F.lit(x)) for x in LISTING_SUFFIXES))
        return (
            F.when(is_blank(u) | single, False).when(F.contains(h, F.lit("greenhouse.io")), greenhouse_listing(u)).when(F.contains(h, F.lit("lever.co")), F.size(s) < 2)
            .when(F.contains(h, F.lit("ashbyhq.com")), (F.size(s) == 0) | (F.size(s) == 1) | ((F.size(s) == 2) & (F.lower(F.get(s, F.lit(1))) == "jobs"))).otherwise(suffix)
        )

    parts = lambda u: F.struct(u.alias("u"), host(u).alias("h"), path(u).alias("p"))
    return once(once(url, parts), lambda x: test(x["u"], x["h"], x["p"]))


def unwrapped(href: Column) -> Column:
    """Target of a '/url?q=' redirect, any other href as it is."""
    h = strip(text(href))
    inner = F.regexp_extract(h, r"[?&]q=([^&#]*)", 1)
    return F.when(F.startswith(h, F.lit("/url?")), strip(text(F.try_url_decode(inner)))).otherwise(h)


def canonical_job_url(href: Column, base: str) -> Column:
    """href without its query, absolute; '' unless it is a job view."""
    h = F.split_part(strip(text(href)), F.lit("?"), F.lit(1))
    return F.when(~F.contains(strip(text(href)), F.lit("/jobs/view/")), "").when(F.startswith(h, F.lit("/")), F.concat(F.lit(base), h)).otherwise(h)


def job_view_id(url: Column) -> Column:
    return F.regexp_extract(text(url), r"(?i)/jobs/view/(\d+)", 1)


def absolute(href: Column, page_url: Column) -> Column:
    """href against its page, without the fragment."""
    u = F.split_part(strip(text(href)), F.lit("#"), F.lit(1))
    root = F.regexp_extract(text(page_url), r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(text(page_url), r"^(https?://[^/]+[^?#]*)", 1), r"/[^/]*$", "/")
    return F.when(u.rlike("^https?://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(root, u)).otherwise(F.concat(folder, u))


# Phrases.

def role_phrases(role: Column) -> Column:
    """Phrases of a role: '|' and ',' part alternatives, 'A/B Word' gives both words."""

    def expand(branch: Column) -> Column:
        b = strip(branch)
        left, right = strip(F.split_part(b, F.lit("/"), F.lit(1))), strip(F.regexp_extract(b, r"^[^/]*/([\s\S]*)$", 1))
        first, suffix = F.regexp_extract(right, r"^(\S+)\s+([\s\S]+)$", 1), F.regexp_extract(right, r"^(\S+)\s+([\s\S]+)$", 2)
        both = F.contains(b, F.lit("/")) & (left != "") & ~F.contains(left, F.lit(" ")) & (first != "")
        return F.when(both, F.array(normal(F.concat(left, F.lit(" "), suffix)), normal(F.concat(first, F.lit(" "), suffix)))).otherwise(F.array(normal(F.replace(b, F.lit("/"), F.lit(" ")))))

    return F.array_distinct(F.filter(F.flatten(F.transform(F.split(strip(text(role)), r"\s*[|,]\s*"), expand)), lambda p: p != ""))


def link_phrases(roles: Column) -> Column:
    """Phrases of at least three characters of an array of roles, or the default ones."""
    found = F.array_distinct(F.filter(F.flatten(F.transform(roles, role_phrases)), lambda p: F.char_length(p) >= 3))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_PHRASES)))


def role_query(role: Column) -> Column:
    r = strip(text(role))
    left, right = strip(F.split_part(r, F.lit("/"), F.lit(1))), strip(F.regexp_extract(r, r"^[^/]*/([\s\S]*)$", 1))
    first, suffix = F.regexp_extract(right, r"^(\S+)\s+([\s\S]+)$", 1), F.regexp_extract(right, r"^(\S+)\s+([\s\S]+)$", 2)
    both = F.contains(r, F.lit("/")) & (left != "") & ~F.contains(left, F.lit(" ")) & (first != "")
    q = F.lit('"')
    return F.when(r == "", "").when(both, F.concat(q, left, F.lit(" "), suffix, F.lit('" OR "'), first, F.lit(" "), suffix, q)).when(F.size(F.split(r, r"\s+")) == 2, F.concat(q, r, q)).otherwise(r)


def location_query(location: Column) -> Column:
    loc = strip(text(location))
    return F.when(loc == "", "").when(F.lower(loc).isin(*GENERIC_LOCATIONS), loc).otherwise(F.concat(F.lit('"'), loc, F.lit('"')))


def search_text(site: Column, role: Column, location: Column) -> Column:
    parts = F.filter(F.array(strip(text(site)), role_query(role), location_query(location)), lambda x: x != "")
    return F.array_join(parts, " ")


# Titles and free text.

def split_title(title: Column) -> Column:
    """struct(title, company): split at the first ' @ ', else ' - ', else ' at '."""

    def parts(t: Column) -> Column:
        def at(sep: str) -> Column:
            n = F.instr(t, sep)
            return F.struct(strip(F.substring(t, F.lit(1), n - 1)).alias("title"), strip(F.substring(t, n + len(sep), F.char_length(t))).alias("company"))

        return F.when(F.contains(t, F.lit(" @ ")), at(" @ ")).when(F.contains(t, F.lit(" - ")), at(" - ")).when(F.contains(t, F.lit(" at ")), at(" at ")).otherwise(F.struct(t.alias("title"), F.lit("").alias("company")))

    return once(strip(text(title)), parts)


def unverified(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"(?i)\s+with verification\s*$", ""))


def split_label(label: Column) -> Column:
    """struct(title, company) of an accessible label: split at the last ' at '."""

    def parts(a: Column) -> Column:
        right = F.substring_index(a, " at ", -1)
        left = F.substring(a, F.lit(1), F.char_length(a) - F.char_length(right) - 4)
        found = F.contains(a, F.lit(" at "))
        return F.struct(unverified(F.when(found, left).otherwise(a)).alias("title"), F.when(found, strip(right)).otherwise("").alias("company"))

    return once(strip(text(label)), parts)


def single_title(title: Column) -> Column:
    """'TitleTitle' becomes 'Title'."""
    t = unverified(strip(text(title)))
    return F.when(F.char_length(t) < 4, t).otherwise(strip(F.regexp_replace(t, r"^([\s\S]{2,})\1[\s\S]*$", "$1")))


def location_in(snippet: Column) -> Column:
    s = strip(text(snippet))
    low = F.lower(s)
    city = F.regexp_extract(s, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2})", 1)
    out = F.when(F.contains(low, F.lit("remote")), "Remote").when(F.contains(low, F.lit("hybrid")), "Hybrid").when(F.contains(low, F.lit("on-site")), "On-Site").when(F.contains(low, F.lit("onsite")), "Onsite")
    return out.when(city != "", city).when(s.rlike(r"(?i)\b(United States|USA|US)\b"), "United States").otherwise("Unknown")


def applicant_phrase(c: Column) -> Column:
    return F.regexp_extract(text(c), r"(?i)(over\s+\d+\s+applicants?|be\s+among\s+the\s+first\s+[\d,]+\s+applicants?|\d+\s*-\s*\d+\s+applicants?|\d+\+?\s+applicants?)", 1)


def employment_label(c: Column) -> Column:
    s = strip(text(c))
    return labelled(F.lower(F.replace(s, F.lit(" "), F.lit(""))), EMPLOYMENT_LABELS, s)


def clip(c: Column, most: int) -> Column:
    """Collapsed text, cut at a word and marked with an ellipsis beyond `most`."""
    t = collapse(c)
    head = F.substring(t, 1, most - 1)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…")))


def html_text(c: Column) -> Column:
    """Visible text of an HTML fragment: no scripts or tags, common entities decoded."""
    t = F.regexp_replace(text(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return collapse(t)


def merged_locations(locations: Column) -> Column:
    """Fold an ordered array of locations into a ' | ' list without case-insensitive repeats.
    What has been merged is split again at '|' before the next value is looked up."""

    def add(done: Column, value: Column) -> Column:
        x = strip(text(value))
        parts = F.filter(F.transform(F.split(done, r"\|"), lambda p: strip(p)), lambda p: p != "")
        seen = F.exists(parts, lambda p: F.lower(p) == F.lower(x))
        return F.array_join(F.when((x != "") & ~seen, F.concat(parts, F.array(x))).otherwise(parts), " | ")

    return F.aggregate(locations, F.lit(""), add)
