"""Queries over payloads, pages, replies and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..operators import filters, joins, stats
from ..sources import history, pages, payloads
from . import pipeline
from .catalogue import AS_OF, query, work_folder
from .history_queries import PLACES, RICH

DAY = "DATE '2000-01-01'"
FIRST_LISTED = "contains(payload, '\"isListed\":true')"
PNAME = "regexp_extract(payload, '\"title\":\"([^\"]*)\"', 1)"


@query(f"""SELECT payload_id, token, 0 AS pos, CAST(payload_id AS VARCHAR) AS id, {PNAME} AS title FROM board_payloads UNION ALL SELECT payload_id, token, 1, CAST(payload_id + 1000000 AS VARCHAR), concat('senior ', {PNAME}) FROM board_payloads""", "board_payloads")
def s7_payload_jobs(b):
    return payloads.jobs(b, "greenhouse").select("payload_id", "token", "pos", F.col("job.id").alias("id"), F.col("job.title").alias("title"))


@query("SELECT o.page_id, p.n FROM (SELECT url, min(page_id) AS page_id, arg_min(length(html), page_id) AS n FROM job_pages GROUP BY url) p JOIN job_pages o ON o.url = p.url", "job_pages")
def s8_page_lookup(p):
    return pages.with_pages(p.select("page_id", "url"), p).select("page_id", F.char_length("html").alias("n"))


@query("SELECT payload_id, concat('[\"', token, '\"]') AS listed, 1 AS n, 0 AS n_bad FROM board_payloads", "board_payloads")
def s10_json_columns(b):
    listed = F.to_json(F.array("token"))
    return b.select("payload_id", listed.alias("listed"), F.size(history.json_list(listed)).alias("n"), F.size(history.json_list(F.concat(F.lit("{"), "token"))).alias("n_bad"))


@query(f"""SELECT payload_id, concat('https://job-boards.greenhouse.io/', token, '/jobs/', CAST(payload_id AS VARCHAR)) AS url FROM board_payloads WHERE {FIRST_LISTED} UNION ALL SELECT payload_id, concat('https://job-boards.greenhouse.io/', token, '/jobs/', CAST(payload_id + 1000000 AS VARCHAR)) FROM board_payloads""", "board_payloads")
def p8_row_guards(b):
    return payloads.postings(b, "greenhouse").select("payload_id", "url")


POSTED = "regexp_extract(payload, '\"updated_at\":\"(2024[^\"]*)\"', 1)"


@query(f"""SELECT payload_id, {PNAME} AS title, concat('Brand ', split_part(token, '-', 2)) AS company, regexp_extract(payload, '"name":"([^"]*)"', 1) AS location, {POSTED} AS posted_time FROM board_payloads WHERE {FIRST_LISTED} AND contains({PNAME}, 'widget')
UNION ALL SELECT payload_id, concat('senior ', {PNAME}), concat('Brand ', split_part(token, '-', 2)), 'Unknown', '' FROM board_payloads WHERE contains({PNAME}, 'widget')""", "board_payloads")
def f31_board_postings(b):
    return payloads.postings(b, "greenhouse", phrases=["widget"]).select("payload_id", "title", "company", "location", "posted_time")


@query("SELECT page_id, url, contains(lower(html), 'captcha') OR contains(lower(html), 'unusual traffic') OR contains(lower(html), 'are you a robot') AS captcha, contains(lower(html), 'no matching jobs found') OR contains(lower(html), 'no results found') OR contains(lower(html), 'did not match any') AS no_results FROM pages", "pages")
def p16_page_flags(p):
    return filters.page_flags(p).select("page_id", "url", "captcha", "no_results")


@query("SELECT row_id, lower(split_part(url, '/', 3)) AS host, array_to_string(list_filter(string_split(split_part(split_part(url, '://', 2), '?', 1), '/')[2:], lambda x: x <> ''), '/') AS segments FROM postings", "postings")
def f1_url_parts(p):
    return p.select("row_id", X.host(F.col("url")).alias("host"), F.array_join(X.segments(F.col("url")), "/").alias("segments"))


@query("SELECT row_id, CASE WHEN contains(url, 'greenhouse.io') THEN split_part(url, '/', 4) ELSE '' END AS greenhouse, CASE WHEN contains(url, 'lever.co') THEN split_part(url, '/', 4) ELSE '' END AS lever FROM postings", "postings")
def f2_board_slug(p):
    return p.select("row_id", X.board_slug(F.col("url"), "greenhouse.io").alias("greenhouse"), X.board_slug(F.col("url"), "lever.co").alias("lever"))


@query("SELECT row_id, CASE WHEN contains(url, 'example.com') THEN '' ELSE concat('Co ', split_part(split_part(url, '/', 4), '-', 2)) END AS company FROM postings", "postings")
def f3_company_from_url(p):
    return p.select("row_id", X.company_from_url(F.col("url")).alias("company"))


BOARD_URL = "CASE WHEN row_id % 3 = 0 THEN regexp_replace(url, '/jobs/.*$', '') WHEN row_id % 3 = 1 THEN regexp_replace(url, '/[0-9]+$', '') ELSE url END"


@query(f"SELECT row_id, CASE WHEN row_id % 3 = 2 THEN false WHEN contains(url, 'example.com') THEN row_id % 3 = 1 WHEN contains(url, 'lever.co') THEN row_id % 3 = 0 ELSE true END AS is_listing FROM postings", "postings")
def f4_listing_page(p):
    url = F.when(F.col("row_id") % 3 == 0, F.regexp_replace("url", "/jobs/.*$", "")).when(F.col("row_id") % 3 == 1, F.regexp_replace("url", "/[0-9]+$", "")).otherwise(F.col("url"))
    return p.select("row_id", X.is_listing_page(url).alias("is_listing"))


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN '' ELSE CAST(page_id AS VARCHAR) END AS job_id FROM job_pages", "job_pages")
def f5_embedded_job_id(p):
    tail = F.when(F.col("page_id") % 3 == 0, "?a=1&gh_jid=").when(F.col("page_id") % 3 == 1, "/gh_jid/").otherwise("/x/")
    return p.select("page_id", X.embedded_job_id(F.concat("url", tail, F.col("page_id").cast("string"))).alias("job_id"))


@query("SELECT row_id, url AS target FROM postings", "postings")
def f6_unwrapped(p):
    return p.select("row_id", X.unwrapped(F.concat(F.lit("/url?sa=t&q="), F.url_encode("url"), F.lit("&usg=x"))).alias("target"))


@query("SELECT row_id, concat('https://www.example.com/jobs/view/', CAST(row_id AS VARCHAR)) AS url, CAST(row_id AS VARCHAR) AS job_id FROM postings", "postings")
def f7_canonical_url(p):
    href = F.concat(F.lit("/jobs/view/"), F.col("row_id").cast("string"), F.lit("?ref=1"))
    url = X.canonical_job_url(href, "https://www.example.com")
    return p.select("row_id", url.alias("url"), X.job_view_id(url).alias("job_id"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('ai ', lower(p_type), '|ml ', lower(p_type)) WHEN 1 THEN concat(p_name, '|', lower(p_type), ' lead') WHEN 2 THEN concat(p_name, ' ', lower(p_type)) ELSE p_name END AS phrases FROM part""", "part")
def f8_role_phrases(part):
    k = F.col("p_partkey") % 4
    role = F.when(k == 0, F.concat(F.lit("AI/ML  "), "p_type")).when(k == 1, F.concat("p_name", F.lit(" | "), "p_type", F.lit("  Lead , "), "p_name")).when(k == 2, F.concat("p_name", F.lit("/"), "p_type")).otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    return part.select("p_partkey", F.array_join(X.role_phrases(role), "|").alias("phrases"))


GENERIC = "('remote','united states','usa','us','anywhere','worldwide','hybrid','on-site','onsite','on site')"


@query("""SELECT p_partkey, concat('site:lever.co ', CASE WHEN p_partkey % 2 = 0 THEN concat('"', p_name, '"') ELSE concat('"AI ', p_type, '" OR "ML ', p_type, '"') END, CASE WHEN p_partkey % 3 = 0 THEN ' Remote' ELSE concat(' "', p_brand, '"') END) AS query FROM part""", "part")
def f10_query_text(part):
    role = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("AI/ML "), "p_type"))
    where = F.when(F.col("p_partkey") % 3 == 0, "Remote").otherwise(F.col("p_brand"))
    return part.select("p_partkey", X.search_text(F.lit("site:lever.co"), role, where).alias("query"))


@query("""SELECT row_id, CASE row_id % 5 WHEN 0 THEN CAST(posted AS TIMESTAMP) WHEN 1 THEN CAST(posted AS TIMESTAMP) + INTERVAL 13 HOUR WHEN 2 THEN CAST(posted AS TIMESTAMP) + INTERVAL 570 MINUTE WHEN 3 THEN NULL ELSE CAST(posted AS TIMESTAMP) END AS at FROM (SELECT row_id, nullif(posted_time, '') AS posted FROM postings) WHERE posted IS NOT NULL""", "postings")
def f12_posted_instant(p):
    k = F.col("row_id") % 5
    raw = F.when(k == 0, F.col("posted_time")).when(k == 1, F.concat("posted_time", F.lit("T09:00:00-04:00"))).when(k == 2, F.concat("posted_time", F.lit("T09:30Z"))).when(k == 3, F.concat("posted_time", F.lit("+05:00"))).otherwise(F.concat("posted_time", F.lit(" 10:00")))
    return p.where("posted_time <> ''").select("row_id", dates.posted_instant(raw).alias("at"))


@query(f"""SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN {DAY} - CAST(n AS INT) WHEN 1 THEN {DAY} - CAST(7 * least(n, 104) AS INT) WHEN 2 THEN {DAY} - CAST(30 * least(n, 24) AS INT) ELSE CAST(TIMESTAMP '{AS_OF}' - n * INTERVAL 1 HOUR AS DATE) END AS VARCHAR) AS posted FROM (SELECT page_id, 1 + page_id % 200 AS n FROM job_pages)""", "job_pages")
def f13_relative_date(p):
    n = (F.col("page_id") % 200 + 1).cast("string")
    unit = F.when(F.col("page_id") % 4 == 0, "days").when(F.col("page_id") % 4 == 1, "weeks").when(F.col("page_id") % 4 == 2, "months").otherwise("hours")
    return p.select("page_id", dates.relative_date(F.concat(F.lit("Role. Posted: "), n, F.lit(" "), unit, F.lit(" ago")), F.lit(AS_OF).cast("timestamp_ntz")).alias("posted"))


FRESH = "CASE p_partkey % 8 WHEN 0 THEN 'Reposted 2 hours ago' WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ' hours ago') WHEN 2 THEN '5 minutes ago' WHEN 3 THEN concat(CAST(1 + p_size % 9 AS VARCHAR), ' days ago') WHEN 4 THEN '1 week ago' WHEN 5 THEN '' WHEN 6 THEN '2 months ago' ELSE 'yesterday' END"


def _fresh(week: bool) -> str:
    hours = "p_size < 24" if not week else "true"
    days = "1 + p_size % 9 <= 7" if week else "false"
    keep = f"CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN {hours} WHEN 2 THEN true WHEN 3 THEN {days} WHEN 7 THEN {str(week).lower()} ELSE false END"
    label = "CASE p_partkey % 8 WHEN 0 THEN 'Reposted — Reposted 2 hours ago' WHEN 1 THEN CASE WHEN p_size < 3 THEN 'Fresh' ELSE t END WHEN 2 THEN 'Fresh' ELSE t END"
    return f"SELECT p_partkey, {keep} AS keep, CASE WHEN {keep} THEN {label} ELSE '' END AS label FROM (SELECT *, {FRESH} AS t FROM part)"


def _fresh_text():
    k, size = F.col("p_partkey") % 8, F.col("p_size")
    return F.when(k == 0, "Reposted 2 hours ago").when(k == 1, F.concat(size.cast("string"), F.lit(" hours ago"))).when(k == 2, "5 minutes ago").when(k == 3, F.concat((size % 9 + 1).cast("string"), F.lit(" days ago"))).when(k == 4, "1 week ago").when(k == 5, "").when(k == 6, "2 months ago").otherwise("yesterday")


@query(_fresh(False), "part")
def f14_freshness_day(part):
    return part.select("p_partkey", dates.freshness(_fresh_text()).alias("f")).select("p_partkey", "f.*")


@query(_fresh(True), "part")
def f14_freshness_week(part):
    return part.select("p_partkey", dates.freshness(_fresh_text(), "week").alias("f")).select("p_partkey", "f.*")


@query(f"""WITH h AS (SELECT lower(trim(title)) AS t, lower(trim(coalesce(company,''))) AS c, source, arg_max(url, (found_at, row_id)) AS prior_url FROM postings WHERE found_at > TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY GROUP BY ALL)
SELECT row_id, CASE WHEN h.prior_url IS NULL OR h.prior_url <> p.url THEN 'Reposted — Reposted 5 hours ago' ELSE 'Posted 5 hours ago' END AS label FROM (SELECT row_id, url, source, lower(trim(title)) AS t, lower(trim(coalesce(company,''))) AS c FROM postings) p LEFT JOIN h ON p.t = h.t AND p.c = h.c AND p.source = h.source AND p.t <> '' AND p.c <> ''""", "postings")
def f15_repost_aware(p):
    rows = p.select("row_id", "title", "company", "source", "url", F.lit("Reposted 5 hours ago").alias("posted"))
    return joins.repost_aware(rows, p, AS_OF, 200, "posted").select("row_id", F.col("freshness.label").alias("label"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Over ', CAST(p_size AS VARCHAR), ' applicants') WHEN 1 THEN 'Be among the first 25 applicants' WHEN 2 THEN concat(CAST(p_size AS VARCHAR), '+ applicants') ELSE '' END AS phrase FROM part", "part")
def f16_applicants(part):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Seen. Over "), n, F.lit(" applicants so far"))).when(k == 1, "Be among the first 25 applicants now").when(k == 2, F.concat(n, F.lit("+ applicants"))).otherwise("We thank all applicants")
    return part.select("p_partkey", X.applicant_phrase(raw).alias("phrase"))


@query("SELECT row_id, trim(title) AS title, CASE WHEN row_id % 2 = 0 THEN concat('Acme - ', CAST(row_id AS VARCHAR)) ELSE coalesce(company,'') END AS company, trim(title) AS label_title FROM postings WHERE trim(title) <> '' AND company IS NOT NULL", "postings")
def f17_split_titles(p):
    name = F.trim("title")
    raw = F.when(F.col("row_id") % 2 == 0, F.concat(name, F.lit(" @ Acme - "), F.col("row_id").cast("string"))).otherwise(F.concat(name, F.lit(" at "), X.text(F.col("company"))))
    label = X.split_label(F.concat(name, F.lit(" with verification at "), X.text(F.col("company")), F.lit("x")))
    rows = p.where("trim(title) <> '' and company is not null").select("row_id", X.split_title(raw).alias("s"), label.alias("l"))
    return rows.select("row_id", "s.title", "s.company", F.col("l.title").alias("label_title"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'remote') THEN 'Remote' WHEN contains(lower(text), 'hybrid') THEN 'Hybrid' WHEN contains(lower(text), 'on-site') THEN 'On-Site' WHEN contains(lower(text), 'onsite') THEN 'Onsite' WHEN regexp_extract(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{2})', 1) <> '' THEN regexp_extract(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{2})', 1) WHEN regexp_matches(text, '(?i)\\b(United States|USA|US)\\b') THEN 'United States' ELSE 'Unknown' END AS location FROM documents WHERE lang = 'en'""", "documents")
def f18_location_in_text(d):
    return d.where("lang = 'en'").select("doc_id", X.location_in(F.col("text")).alias("location"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'remote') THEN 'Remote' WHEN contains(lower(text), 'hybrid') THEN 'Hybrid' WHEN contains(lower(text), 'on-site') THEN 'On-Site' WHEN contains(lower(text), 'onsite') THEN 'Onsite' WHEN regexp_extract(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{2})', 1) <> '' THEN regexp_extract(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{2})', 1) WHEN regexp_matches(text, '(?i)\\b(United States|USA|US)\\b') THEN 'United States' ELSE 'Unknown' END AS location FROM documents""", "documents")
def f18_location_in_all_texts(d):
    return d.select("doc_id", X.location_in(F.col("text")).alias("location"))


ANCHORS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', {})"""
LINKS = f"""a AS (SELECT page_id, url, unnest(list_zip({ANCHORS.format(1)}, {ANCHORS.format(2)}, range(0, len({ANCHORS.format(1)})))) AS z FROM pages), b AS (SELECT page_id, url, trim(z[1]) AS href, z[2] AS inner_html, z[3] AS pos FROM a),
c AS (SELECT page_id, url, href, inner_html, pos, CASE WHEN regexp_matches(split_part(href,'#',1), '^https?://') THEN split_part(href,'#',1) WHEN starts_with(href, '//') THEN concat('https:', split_part(href,'#',1)) WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(https?://[^/]+)', 1), split_part(href,'#',1)) ELSE concat(regexp_replace(regexp_extract(url, '^(https?://[^/]+[^?#]*)', 1), '/[^/]*$', '/'), split_part(href,'#',1)) END AS link FROM b WHERE href <> '' AND NOT regexp_matches(lower(href), '^(mailto|javascript|tel):') AND NOT starts_with(href, '/url?')),
links AS (SELECT page_id, url, link, arg_min(href, pos) AS href, arg_min(regexp_replace(inner_html, '(?s)<[^>]*>', ' ', 'g'), pos) AS text, min(pos) AS pos FROM c WHERE link <> '' AND regexp_replace(link, '/+$', '') <> regexp_replace(split_part(url,'#',1), '/+$', '') GROUP BY 1, 2, 3)"""


@query(f"WITH {LINKS} SELECT page_id, link, pos FROM links", "pages")
def f19_links(p):
    return pages.links(p).where("not startswith(href, '/url?')").select("page_id", "link", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {LINKS} SELECT page_id, link FROM links WHERE regexp_matches(concat(lower(href), ' ', lower(text)), 'attion|thanedble|with')", "pages")
def f9_kept_links(p):
    phrases = p.select(F.explode(X.link_phrases(F.array(F.lit("Attion | thanedble"), F.lit("with, to")))).alias("phrase")).distinct()
    return pages.kept_links(pages.links(p), phrases).where("not startswith(href, '/url?')").select("page_id", "link")


@query(f"WITH {LINKS}, found AS (SELECT page_id, url AS page_url, regexp_replace(link, '^https?://[^/]+', 'https://jobs.lever.co') AS new_url FROM links) SELECT DISTINCT page_url, new_url, 'lever' AS platform, 'board' AS source FROM found WHERE page_id % 2 = 0 AND new_url NOT IN (SELECT new_url FROM found WHERE page_id % 2 <> 0)", "pages")
def j12_new_links(p):
    board = F.regexp_replace("link", "^https?://[^/]+", "https://jobs.lever.co").alias("url")
    found = pages.links(p).where("not startswith(href, '/url?')").select("page_url", "page_id", board)
    known = found.where("page_id % 2 <> 0")  # the links of every other page, which stands for one stored before
    template = p.select("url", F.lit("board").alias("source"), F.lit("role").alias("search_role"), F.lit("").alias("company"))
    fresh = joins.new_links(found.where("page_id % 2 = 0").drop("page_id").distinct(), known, template)
    return fresh.select("page_url", F.col("url").alias("new_url"), "platform", "source")


@query(f"WITH {LINKS}, found AS (SELECT DISTINCT url AS page_url, regexp_replace(link, '^https?://[^/]+', 'https://jobs.lever.co') AS new_url FROM links) SELECT page_url, new_url, 'lever' AS platform, 'board' AS source FROM found WHERE new_url NOT IN (SELECT new_url FROM found WHERE length(new_url) % 3 = 0)", "pages")
def j12_new_links_of_all_pages(p):
    board = F.regexp_replace("link", "^https?://[^/]+", "https://jobs.lever.co").alias("url")
    found = pages.links(p).where("not startswith(href, '/url?')").select("page_url", board).distinct()
    known = found.where("char_length(url) % 3 = 0")
    template = p.select("url", F.lit("board").alias("source"), F.lit("role").alias("search_role"), F.lit("").alias("company"))
    return joins.new_links(found, known, template).select("page_url", F.col("url").alias("new_url"), "platform", "source")


@query(f"WITH {LINKS} SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM links) WHERE rn <= 4", "pages")
def t4_page_links(p):
    found = pages.links(p).where("not startswith(href, '/url?')")
    return filters.capped(found, ["page_id"], ["pos"], 4).select("page_id", "link")


@query("SELECT row_id, trim(title) AS title FROM postings", "postings")
def f20_single_titles(p):
    return p.select("row_id", X.single_title(F.concat(F.trim("title"), F.trim("title"))).alias("title"))


@query("SELECT location, array_to_string([location, concat(location, '-b')], ' | ') AS merged FROM (SELECT DISTINCT location FROM postings)", "postings")
def f21_locations(p):
    few = p.select("location").distinct()
    return few.select("location", X.merged_locations(F.array(F.col("location"), F.lit(" "), F.upper("location"), F.concat("location", F.lit("-b")), F.lower("location"))).alias("merged"))


@query("SELECT row_id, coalesce(employment_type, 'Contract') AS label, coalesce(nullif(trim(salary),''), nullif(trim(freshness),''), '') AS picked FROM postings", "postings")
def f22_labels(p):
    kind = F.when(F.col("employment_type").isNotNull(), F.lit("Full Time")).otherwise("CONTRACT")
    return p.select("row_id", X.employment_label(kind).alias("label"), X.first_filled(F.col("salary"), F.col("freshness")).alias("picked"))


HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, t AS text, CASE WHEN length(t) <= 100 THEN t ELSE concat(regexp_replace(substr(t, 1, 99), ' [^ ]*$', ''), '…') END AS clipped FROM (SELECT page_id, {HTML} AS t FROM pages)", "pages")
def f23_html_text(p):
    text = X.html_text(F.col("html"))
    return p.select("page_id", text.alias("text"), X.clip(text, 100).alias("clipped"))


@query("SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'A job page without any date, long enough to be kept as the description text.' ELSE '' END AS description FROM job_pages", "job_pages")
def f25_description(p):
    return pages.described(p).select("page_id", F.col("job_description").alias("description"))


ORDER_DATE = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
PUBLISHED = f"CASE o_orderkey % 7 WHEN 1 THEN concat({ORDER_DATE}, 'T09:00:00-04:00') WHEN 2 THEN {ORDER_DATE} ELSE '' END"


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'X' ELSE '' END AS title, {PUBLISHED} AS published FROM orders", "job_pages", "orders")
def f26_embedded_state(p, _):
    jp, ap = F.col("_job"), F.col("_posting")
    return pages.with_state(p).select("page_id", F.coalesce(pages.get(jp, "$.title"), pages.get(ap, "$.title"), F.lit("")).alias("title"), F.coalesce(pages.get(jp, "$.published_at"), pages.get(ap, "$.publishedDate"), F.lit("")).alias("published"))


@query(f"SELECT o_orderkey AS page_id, {ORDER_DATE} AS found FROM orders WHERE o_orderkey % 7 = 0", "job_pages", "orders")
def f27_json_paths(p, _):
    return pages.with_state(p).select("page_id", pages.get(F.col("_ld"), "$.datePosted", "$.dateposted").alias("found")).where("found is not null")


@query(f"SELECT o_orderkey AS page_id, o_orderpriority AS title, concat('C', CAST(o_custkey AS VARCHAR)) AS company, {ORDER_DATE} AS posted_time FROM orders WHERE o_orderkey % 7 = 0", "job_pages", "orders")
def f28_json_ld(p, _):
    fields = pages.ld_fields(F.col("_ld"))
    return pages.with_state(p).select("page_id", *(fields[c].alias(c) for c in ("title", "company", "posted_time"))).where("title is not null")


RELATIVE = f"CAST({DAY} - CAST(1 + o_custkey % 20 AS INT) AS VARCHAR)"
EXTRACTOR = "CASE WHEN o_orderkey % 7 = 0 THEN 'json_ld' WHEN o_orderkey % 7 = 1 AND o_orderkey % 4 = 0 THEN 'remix' WHEN o_orderkey % 7 = 2 AND o_orderkey % 4 = 2 THEN 'ashby_state' WHEN o_orderkey % 7 = 3 AND o_orderkey % 4 = 1 THEN 'lever_state' WHEN o_orderkey % 7 = 4 THEN 'meta' WHEN o_orderkey % 7 = 5 THEN 'relative' END"


@query(f"SELECT o_orderkey AS page_id, {EXTRACTOR} AS extractor, CASE {EXTRACTOR} WHEN 'remix' THEN concat({ORDER_DATE}, 'T09:00:00-04:00') WHEN 'lever_state' THEN concat({ORDER_DATE}, 'T00:00:00Z') WHEN 'relative' THEN {RELATIVE} WHEN 'json_ld' THEN {ORDER_DATE} WHEN 'ashby_state' THEN {ORDER_DATE} WHEN 'meta' THEN {ORDER_DATE} END AS posted_time FROM orders", "job_pages", "orders")
def f29_posted_dates(p, _):
    return pages.posted_dates(p, AS_OF).select("page_id", "extractor", "posted_time")


@query(f"SELECT coalesce({EXTRACTOR}, 'missing') AS extractor, count(*) AS n FROM orders GROUP BY 1", "job_pages", "orders")
def a8_enrichment_counters(p, _):
    return stats.enrichment_counters(pages.posted_dates(p, AS_OF))


@query(f"SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'X' WHEN 2 THEN 'X' ELSE '' END AS title, CASE WHEN o_orderkey % 7 = 0 THEN concat('C', CAST(o_custkey AS VARCHAR)) ELSE '' END AS company, CASE WHEN o_orderkey % 7 = 0 THEN {ORDER_DATE} ELSE {PUBLISHED} END AS posted_time FROM orders", "job_pages", "orders")
def f30_page_patches(p, _):
    return pages.page_patches(p).select("page_id", "title", "company", "posted_time")


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 7 = 0 THEN {ORDER_DATE} WHEN o_orderkey % 7 IN (1, 2) THEN {PUBLISHED} ELSE 'old' END AS posted_time FROM orders", "job_pages", "orders")
def j6_patch_overwrite(p, _):
    rows = p.select("page_id", "url", F.lit("old").alias("posted_time"))
    return joins.patch(rows, pages.page_patches(p), "page_id", ["posted_time"], overwrite=True).select("page_id", "posted_time")


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' WHEN o_orderkey % 7 = 0 THEN {ORDER_DATE} ELSE {PUBLISHED} END AS posted_time FROM orders", "job_pages", "orders")
def j7_patch_fill(p, _):
    rows = p.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "kept").otherwise(" ").alias("posted_time"))
    return joins.patch(rows, pages.page_patches(p), "page_id", ["posted_time"], overwrite=False).select("page_id", "posted_time")


KEY_BRAND = "CAST(row_id % 25 AS VARCHAR)"
BOARD_ROWS = f"""r AS (SELECT row_id, title, concat('Brand ', {KEY_BRAND}) AS company, CASE WHEN row_id % 7 = 0 THEN concat('https://job-boards.greenhouse.io/brand-', {KEY_BRAND}, '/jobs/', CAST(row_id % 200 AS VARCHAR), '/') ELSE url END AS url, location, posted_time, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t, concat('brand ', {KEY_BRAND}) AS c FROM postings),
b AS (SELECT concat('https://job-boards.greenhouse.io/', token, '/jobs/', id) AS url, title, concat('Brand ', split_part(token, '-', 2)) AS company, location, posted_time, id, lower(title) AS t, concat('brand ', split_part(token, '-', 2)) AS c FROM (SELECT token, CAST(payload_id AS VARCHAR) AS id, {PNAME} AS title, regexp_extract(payload, '"name":"([^"]*)"', 1) AS location, {POSTED} AS posted_time FROM board_payloads WHERE {FIRST_LISTED} UNION ALL SELECT token, CAST(payload_id + 1000000 AS VARCHAR), concat('senior ', {PNAME}), 'Unknown', '' FROM board_payloads)),
l AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY id) AS rn FROM b WHERE url NOT IN (SELECT rtrim(url, '/') FROM r)), one AS (SELECT * FROM l WHERE rn = 1),
f AS (SELECT t, c, min(row_id) AS row_id FROM r WHERE t <> '' GROUP BY 1, 2), k AS (SELECT f.row_id, one.* EXCLUDE (rn) FROM one JOIN f ON one.t = f.t AND one.c = f.c)"""


@query(f"""WITH {BOARD_ROWS} SELECT r.row_id, r.url, r.title, r.location, coalesce(nullif(trim(r.posted_time), ''), nullif(b.posted_time, ''), nullif(k.posted_time, ''), '') AS posted_time, CASE WHEN b.url IS NOT NULL THEN 'url' WHEN k.url IS NOT NULL THEN 'key' ELSE '' END AS matched FROM r LEFT JOIN b ON rtrim(r.url, '/') = b.url LEFT JOIN k ON k.row_id = r.row_id
UNION ALL SELECT NULL, url, title, location, posted_time, 'new' FROM one WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = one.t AND f.c = one.c)""", "postings", "board_payloads")
def j8_board_expansion(p, b):
    brand = (F.col("row_id") % 25).cast("string")
    url = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("https://job-boards.greenhouse.io/brand-"), brand, F.lit("/jobs/"), (F.col("row_id") % 200).cast("string"), F.lit("/"))).otherwise(F.col("url"))
    rows = p.withColumns({"company": F.concat(F.lit("Brand "), brand), "url": url})
    board = payloads.postings(b, "greenhouse").withColumnRenamed("job_id", "posting_id")
    return joins.expand_boards(rows, board).select("row_id", "url", "title", "location", "posted_time", "matched")


@query("SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS job_id, lower(replace(p_brand, '#', '-')) AS token FROM part", "part", "board_payloads")
def j13_embedded_board(part, b):
    board = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    html = F.concat(F.lit('<a href="https://boards.greenhouse.io/embed/x">a</a><script src="https://boards.greenhouse.io/nobody?x"></script><script src="https://boards-api.greenhouse.io/v1/boards/'), board, F.lit('/jobs"></script>'))
    made = part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://www.example.com/?gh_jid="), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    jobs = payloads.jobs(b, "greenhouse").select("token", F.col("job.id").alias("job_id"))
    return joins.embedded_board(made, pages.board_tokens(made), jobs)


@query("SELECT p_partkey AS page_id, concat(lower(replace(p_brand, '#', '-')), ',nobody') AS tokens FROM part", "part")
def f33_board_tokens(part):
    board = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    html = F.concat(F.lit("https://boards.greenhouse.io/embed/x https://job-boards.greenhouse.io/nobody boards-api.greenhouse.io/v1/boards/"), board, F.lit("/"))
    rows = pages.board_tokens(part.select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), ",").alias("tokens"))


@query("SELECT batch_id, reply_no, unnest([1, 2, 3, CAST(4 + batch_id % 5 AS INT)]) AS position, unnest([true, false, true, false]) AS keep FROM model_replies", "model_replies")
def f34_reply_decisions(r):
    return payloads.reply_decisions(r, ["batch_id", "reply_no"])


@query("SELECT batch_id, reply_no, position FROM (SELECT batch_id, reply_no, unnest(range(1, 10)) AS position FROM model_replies) WHERE position <> 2 AND position <> 4 + batch_id % 5", "model_replies")
def j11_decisions(r):
    rows = r.select("batch_id", "reply_no", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("position"))
    return joins.decisions(rows, payloads.reply_decisions(r, ["batch_id", "reply_no"]), ["batch_id", "reply_no", "position"])


@query("SELECT p_partkey, 0 AS pos, p_name AS title, p_brand AS company, concat('https://x.example/', CAST(p_partkey AS VARCHAR)) AS url, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS easy_apply FROM part", "part")
def f35_reply_rows(part):
    k = F.col("p_partkey") % 3
    easy = F.when(k == 0, ', "easy_apply": "Yes"').when(k == 1, ', "easy_apply": false').otherwise("")
    item = F.concat(F.lit('[{"title": "'), "p_name", F.lit('", "company": "'), "p_brand", F.lit('", "url": "https://x.example/'), F.col("p_partkey").cast("string"), F.lit('"'), easy, F.lit('}, {"title": "no url"}]'))
    reply = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), item, F.lit("\n```"))).when(k == 1, F.concat(F.lit('{"jobs": '), item, F.lit("}"))).otherwise(F.concat(F.lit("I found "), item, F.lit(" done")))
    rows = payloads.reply_rows(part.select("p_partkey", reply.alias("reply")))
    return rows.withColumn("easy_apply", X.text(F.col("easy_apply")))


@query("SELECT p_partkey, p_name AS title, p_brand AS company, concat('https://x.example/', CAST(p_partkey AS VARCHAR)) AS url, concat(p_type, chr(10), 'Work model: Hybrid', chr(10), 'Remote: yes') AS job_description FROM part", "part")
def f32_detail_rows(part):
    text = F.to_json(F.struct(F.struct(F.col("p_name").alias("jobTitle"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("originalUrl"), F.col("p_type").alias("jobSummary"), F.lit("Hybrid").alias("workModel"), F.lit(True).alias("isRemote")).alias("jobResult"), F.struct(F.col("p_brand").alias("companyName")).alias("companyResult")))
    return payloads.detail_rows(part.select("p_partkey", text.alias("payload")), gap="\n", remote={"true": "yes"}).select("p_partkey", "title", "company", "url", "job_description")


@query("""SELECT p_partkey, p_name AS title, coalesce(nullif(p_brand, 'Brand#11'), 'Unknown') AS company, concat('https://x.example/', CAST(p_partkey AS VARCHAR)) AS url, 'Unknown' AS location, concat('2024-01-', lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0'), 'T08:30:00') AS posted_time, '5h ago' AS freshness,
concat(p_type, chr(10), chr(10), 'Work model: Hybrid', chr(10), 'Remote: ', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, chr(10), 'Jobright match score: ', CAST(p_partkey AS VARCHAR)) AS job_description FROM part""", "part")
def f32_detail_rows_in_full(part):
    def one(*names):
        job = dict(zip(("title", "url", "summary", "model", "at", "said"), (F.col("p_name"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")), F.col("p_type"), F.lit("Hybrid"), F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"), F.lit(" 08:30:00")), F.lit("5h ago"))))
        top, company, name, *keys = names
        return F.to_json(F.struct(F.struct(*(c.alias(k) for k, c in zip(keys, job.values())), (F.col("p_partkey") % 2 == 0).alias("isRemote")).alias(top), F.struct(F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias(name)).alias(company), F.col("p_partkey").alias("displayScore")))

    camel = one("jobResult", "companyResult", "companyName", "jobTitle", "originalUrl", "jobSummary", "workModel", "publishTime", "publishTimeDesc")
    snake = one("job_result", "company_result", "company_name", "job_title", "apply_link", "job_summary", "work_model", "publish_time", "publish_time_desc")
    rows = payloads.detail_rows(part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, camel).otherwise(snake).alias("payload")))
    return rows.select("p_partkey", "title", "company", "url", "location", "posted_time", "freshness", "job_description")


@query("SELECT p_partkey AS page_id, concat('https://www.linkedin.com/jobs/view/', CAST(p_partkey AS VARCHAR)) AS url, trim(p_name) AS title, p_brand AS company, p_type AS location, CAST(p_partkey AS VARCHAR) AS job_id FROM part", "part")
def f19_result_rows(part):
    k = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<li><a class="full-link" href="/jobs/view/'), k, F.lit('?trk=a"><h3> '), "p_name", F.lit(' </h3></a><h4 class="card__subtitle">'), "p_brand", F.lit('</h4><span class="card__location">'), "p_type", F.lit("</span></li>"))
    html = F.concat(F.lit("<ul>"), card, F.lit("<li>no link</li>"), card, F.lit("</ul>"))
    wide = part.repartition(part.sparkSession.sparkContext.defaultParallelism).select(F.col("p_partkey").alias("page_id"), html.alias("html"))  # from a narrow file of one split
    return pages.result_rows(wide, "https://www.linkedin.com").select("page_id", "url", "title", "company", "location", "job_id")


@query("SELECT row_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS collapsed, lower(trim(title)) AS trimmed FROM postings", "postings")
def f36_keys(p):
    return p.select("row_id", X.normal(F.col("title")).alias("collapsed"), X.key(F.col("title")).alias("trimmed"))


@query("SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS n_pages, count(*) FILTER (WHERE len(regexp_extract_all(html, '(?i)<a ')) + len(regexp_extract_all(html, '(?i)<h[1-6]')) + len(regexp_extract_all(html, '(?i)<li')) > 0) AS n_with_hits, sum(len(regexp_extract_all(html, '(?i)<a '))) AS anchors, sum(len(regexp_extract_all(html, '(?i)<h[1-6]'))) AS headings, sum(len(regexp_extract_all(html, '(?i)<li'))) AS items FROM pages GROUP BY 1", "pages")
def a11_markup_profile(p):
    return stats.markup_profile(p, {"anchors": "(?i)<a ", "headings": "(?i)<h[1-6]", "items": "(?i)<li"})


@query(f"SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 7 IN (1, 2) THEN 'state' ELSE {EXTRACTOR} END AS extractor, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN {ORDER_DATE} WHEN o_orderkey % 7 IN (1, 2) THEN {PUBLISHED} ELSE CASE {EXTRACTOR} WHEN 'lever_state' THEN concat({ORDER_DATE}, 'T00:00:00Z') WHEN 'relative' THEN {RELATIVE} WHEN 'meta' THEN {ORDER_DATE} END END, '') AS posted_time FROM orders", "job_pages", "orders")
def f37_enrichment(p, _):
    rows = p.select(F.col("page_id").alias("row_id"), "url", *(F.lit("").alias(c) for c in ("title", "company", "posted_time", "location", "salary", "employment_type", "job_description")))
    return pages.enrich(rows, p, AS_OF).select("row_id", "extractor", "posted_time")


RUN = f"""WITH p AS (SELECT *, lower(trim(title)) AS t, lower(trim(coalesce(company, ''))) AS c FROM postings WHERE source IN ('linkedin','indeed','ats') AND (contains(lower(title), 'ring') OR contains(lower(title), 'widget'))), {PLACES},
g AS (SELECT t, c, count(*) AS n, arg_max(row_id, ({RICH}, -row_id)) AS row_id, arg_max(title, ({RICH}, -row_id)) AS title, arg_max(coalesce(company,''), ({RICH}, -row_id)) AS company, arg_max(url, ({RICH}, -row_id)) AS url, arg_max(location, ({RICH}, -row_id)) AS own FROM p WHERE t <> '' AND c <> '' GROUP BY t, c),
m AS (SELECT row_id, title, company, url, CASE WHEN n = 1 THEN own ELSE l.loc END AS location FROM g JOIN l ON g.t = l.t AND g.c = l.c UNION ALL SELECT row_id, title, coalesce(company,''), url, location FROM p WHERE t = '' OR c = '')
SELECT row_id, title, company, url, location FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id) AS rn FROM m WHERE url NOT IN (SELECT url FROM postings WHERE source = 'yc' AND found_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)) WHERE rn = 1"""


@query(RUN, "postings")
def e1_run(p):
    from ..schema import Params

    sources = {s: p.where(F.col("source") == s) for s in ("linkedin", "indeed", "ats")}
    return pipeline.run(sources, p.where("source = 'yc'"), Params(roles=("ring | widget",), include_easy_apply=True, dedup_days=30), AS_OF).select("row_id", "title", "company", "url", "location")


@query(RUN, "postings")
def x3_incremental_run(p):
    from ..schema import Params
    from ..streaming import streams

    spark, path = p.sparkSession, work_folder(p.sparkSession)
    history.append(p.where("source = 'yc'"), f"{path}/history", batch="before")
    rows = p.where("source in ('linkedin', 'indeed', 'ats')")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    params = Params(roles=("ring | widget",), include_easy_apply=True, dedup_days=30)
    streams.incremental_run(stream, f"{path}/history", params, AS_OF, f"{path}/checkpoint").awaitTermination()
    stored = history.scan_other_batches(spark, f"{path}/history", "before")
    return stored.select("row_id", "title", "company", "url", F.coalesce("location", F.lit("")).alias("location"))
