"""Joins: windows of time, as-of lookups, phrases, patches and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text as X
from .filters import first_per, found_between, window_start


def unseen(candidates: DataFrame, history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Candidates whose URL was not stored within the last `days` days (strictly)."""
    recent = found_between(history, after=window_start(as_of, days)).select(F.col("url").alias("_seen")).distinct()
    return candidates.join(recent, F.trim("url") == F.col("_seen"), "left_anti")


def prior_url(candidates: DataFrame, history: DataFrame, as_of: str, days: int, order: str = "row_id") -> DataFrame:
    """candidates with prior_url: the newest stored URL of the same title, company and
    source in the window; null where title or company is blank or none is stored."""
    stored = found_between(history, after=window_start(as_of, days)).groupBy(X.key(F.col("title")).alias("_t"), X.key(F.col("company")).alias("_c"), F.col("source").alias("_s")).agg(F.max_by("url", F.struct("found_at", order)).alias("prior_url"))
    stored = stored.where("_t <> '' and _c <> ''")
    same = (X.key(F.col("title")) == F.col("_t")) & (X.key(F.col("company")) == F.col("_c")) & (F.col("source") == F.col("_s"))
    return candidates.join(stored, same, "left").drop("_t", "_c", "_s")


def repost_aware(candidates: DataFrame, history: DataFrame, as_of: str, days: int, posted: str, window: str = "24h") -> DataFrame:
    """candidates with their freshness (keep, label) by the text column `posted`: a repost
    counts as one only if no row of the same title, company and source was stored under this
    very URL as the newest of the window; else its text is read as a first posting."""
    prior = prior_url(candidates, history, as_of, days)
    known = F.col("prior_url").isNotNull() & (F.col("prior_url") == F.col("url"))
    plain = F.when(known, F.regexp_replace(posted, r"(?i)\breposted\b", "Posted")).otherwise(F.col(posted))
    return prior.withColumn("freshness", dates.freshness(plain, window)).drop("prior_url")


#: Phrase tables of up to so many rows are broadcast and tried one by one.
FEW_PHRASES = 2_000
GRAM = 3


def grams(c: Column) -> Column:
    """The distinct three-character substrings of a text; none of a shorter one."""
    at = F.sequence(F.lit(1), F.char_length(c) - (GRAM - 1))
    return F.when(F.char_length(c) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(GRAM)))))


def matching_titles(titles: DataFrame, phrases: DataFrame, few: int = FEW_PHRASES) -> DataFrame:
    """Every (name, phrase) with the phrase in the title, for distinct normal titles (name).

    Up to `few` phrases, which is counted, are broadcast. More are joined by one of their
    three-character substrings with those of the titles, and then tested: by the one that the
    fewest titles have, so that a common beginning makes no hot key. A phrase with a substring
    that no title has is in none. Phrases shorter than that, of which there can only be few, are
    always tried one by one."""
    known = phrases.select("phrase").where("phrase <> ''").distinct()
    if known.limit(few + 1).count() <= few:
        return titles.join(F.broadcast(known), F.contains("name", F.col("phrase")))
    cut = titles.select("name", F.explode(grams(F.col("name"))).alias("gram"))
    often = cut.groupBy(F.col("gram").alias("t_gram")).agg(F.count("*").alias("n"))
    parts = known.select("phrase", F.explode(grams(F.col("phrase"))).alias("p_gram")).join(often, F.col("p_gram") == F.col("t_gram"), "left")
    rarest = parts.groupBy("phrase").agg(F.min_by("p_gram", F.struct(F.coalesce("n", F.lit(0)), "p_gram")).alias("p_gram"), F.count_if(F.col("n").isNull()).alias("absent")).where("absent = 0")
    found = cut.join(rarest, F.col("gram") == F.col("p_gram")).where(F.contains("name", F.col("phrase"))).select("name", "phrase")
    short = known.where(F.char_length("phrase") < GRAM)
    return found.unionByName(titles.join(short, F.contains("name", F.col("phrase"))).select("name", "phrase"))


def phrase_pairs(df: DataFrame, phrases: DataFrame, title: str = "title", few: int = FEW_PHRASES) -> DataFrame:
    """Every (row, phrase) with the phrase in the title; titles are matched once each."""
    name = X.normal(F.col(title))
    found = matching_titles(df.select(name.alias("name")).distinct(), phrases, few).withColumnsRenamed({"name": "_name", "phrase": "_phrase"})
    return df.join(found, name == F.col("_name")).join(phrases, F.col("_phrase") == F.col("phrase")).drop("_name", "_phrase")


def title_matches(df: DataFrame, phrases: DataFrame, title: str = "title", few: int = FEW_PHRASES) -> DataFrame:
    """Rows whose title contains any phrase."""
    name = X.normal(F.col(title))
    found = matching_titles(df.select(name.alias("name")).distinct(), phrases, few).select(F.col("name").alias("_name")).distinct()
    return df.join(found, name == F.col("_name"), "left_semi")


def upsert(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """right's filled values overwrite left's; keys of either side remain."""
    other = [c for c in left.columns if c != key]
    r = right.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_r_{c}") for c in other if c in right.columns))
    joined = left.join(r, F.col(key) == F.col("_k"), "full_outer")
    merged = [F.coalesce(X.filled(F.col(f"_r_{c}")), F.col(c)).alias(c) if c in right.columns else F.col(c) for c in other]
    return joined.select(F.coalesce(key, "_k").alias(key), *merged)


def patch(df: DataFrame, patches: DataFrame, key: str, fields: list[str], overwrite: bool) -> DataFrame:
    """Filled patch fields replace the row's, or with overwrite=False only fill blank ones."""
    p = patches.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_p_{c}") for c in fields))
    joined = df.join(p, F.col(key) == F.col("_k"), "left")
    both = {c: (X.filled(F.col(f"_p_{c}")), X.filled(F.col(c))) for c in fields}
    return joined.withColumns({c: F.coalesce(*(pair if overwrite else pair[::-1]), F.lit("")) for c, pair in both.items()}).select(*df.columns)


def board_template(df: DataFrame, order: str = "row_id") -> DataFrame:
    """First row per board URL: role, location, source, company."""
    return first_per(df, ["url"], [order])


def expand_boards(rows: DataFrame, board: DataFrame, order: str = "row_id") -> DataFrame:
    """Merge board postings into rows. board: url, title, company, location, posted_time,
    job_description, posting_id. A posting matches the rows of its URL, else the first row
    of its title and company; blank fields are filled, the rest is appended once per key.
    Rows are filled from the first posting of their URL, but all postings of an unmatched URL
    count for the key, as different ones may share it. Of one id the least posting is taken.
    Adds matched: 'url', 'key', 'new' or ''."""
    fields = ["location", "posted_time", "job_description"]
    bare = lambda c: F.regexp_replace(X.strip(X.text(c)), "/+$", "")
    b = board.select(bare(F.col("url")).alias("_u"), F.col("url").alias("_b_url"), X.normal(F.col("title")).alias("_bt"), X.normal(F.col("company")).alias("_bc"), *(F.col(c).alias(f"_b_{c}") for c in ["title", "company", *fields]), "posting_id")
    order_b = ["posting_id", "_b_title", "_b_company", "_b_url", *(f"_b_{c}" for c in fields)]
    keyed = rows.withColumns({"_u_row": bare(F.col("url")), "_t": X.normal(F.col("title")), "_c": X.normal(F.col("company"))})
    by_url = keyed.join(first_per(b, ["_u"], order_b), F.col("_u_row") == F.col("_u"), "left")
    known = keyed.select(F.col("_u_row").alias("_known")).distinct()
    left_over = b.join(known, F.col("_u") == F.col("_known"), "left_anti")
    one = first_per(left_over, ["_bt", "_bc"], order_b)
    first_of_key = keyed.where("_t <> '' and _c <> ''").groupBy("_t", "_c").agg(F.min(order).alias("_first"))
    by_key = one.join(first_of_key, (F.col("_bt") == F.col("_t")) & (F.col("_bc") == F.col("_c"))).select("_first", *(F.col(f"_b_{c}").alias(f"_k_{c}") for c in ["url", *fields]))
    joined = by_url.join(by_key, F.col(order) == F.col("_first"), "left")
    filled = {c: F.coalesce(X.filled(F.col(c)), X.filled(F.col(f"_b_{c}")), X.filled(F.col(f"_k_{c}")), F.lit("")) for c in fields}
    url = F.when(F.col("_first").isNotNull() & X.is_listing_page(F.col("url")), F.col("_k_url")).otherwise(F.col("url"))
    how = F.when(F.col("_u").isNotNull(), "url").when(F.col("_first").isNotNull(), "key").otherwise("")
    merged = joined.withColumns(filled | {"url": url, "matched": how}).select(*rows.columns, "matched")
    new = one.join(first_of_key, (F.col("_bt") == F.col("_t")) & (F.col("_bc") == F.col("_c")), "left_anti")
    made = {"url": F.col("_b_url"), "title": F.col("_b_title"), "company": F.col("_b_company"), "source": F.lit("ats"), "apply_type": F.lit("external")} | {c: F.coalesce(F.col(f"_b_{c}"), F.lit("")) for c in fields}
    added = new.select(*(made.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns), F.lit("new").alias("matched"))
    return merged.unionByName(added)


def search_plan(roles: DataFrame, locations: DataFrame, sites: DataFrame, pages: int, per_page: int = 10) -> DataFrame:
    """Every (role, location, platform, page) with its query text and paging offset. All
    three inputs are short lists of settings."""
    plan = roles.crossJoin(locations).crossJoin(sites)
    plan = plan.withColumn("page_no", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    return plan.withColumns({"query": X.search_text(F.col("site"), F.col("role"), F.col("location")), "start": F.col("page_no") * per_page})


def decisions(rows: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a decision, or with a positive one."""
    r = replies.select(*(F.col(k).alias(f"_d_{k}") for k in keys), "keep")
    on = [F.col(k) == F.col(f"_d_{k}") for k in keys]
    return rows.join(r, on, "left").where(F.coalesce("keep", F.lit(True))).select(*rows.columns)


def new_links(links: DataFrame, known: DataFrame, template: DataFrame) -> DataFrame:
    """Discovered links (page_url, url, text) on a known platform and not known yet, with
    the fields of their page's template row (url, source, search_role, company): of several
    rows of one page the least, so that a page listed twice gives its links once."""
    fresh = links.withColumn("platform", X.platform(F.col("url"))).where("platform <> ''").join(known.select(F.col("url").alias("_known")).distinct(), F.col("url") == F.col("_known"), "left_anti")
    fields = ("source", "search_role", "company")
    t = template.groupBy(F.col("url").alias("_page")).agg(F.min(F.struct(*fields)).alias("_t")).select("_page", *(f"_t.{c}" for c in fields))
    return fresh.join(t, F.col("page_url") == F.col("_page"), "left").drop("_page")


def embedded_board(pages: DataFrame, tokens: DataFrame, payload_jobs: DataFrame) -> DataFrame:
    """For pages with an embedded job id: the first candidate token (page_id, pos, token)
    whose payload (token, job_id) has that job."""
    wanted = pages.withColumn("job_id", X.embedded_job_id(F.col("url"))).where("job_id <> ''").select("page_id", "job_id")
    found = wanted.join(tokens, "page_id").join(payload_jobs, ["token", "job_id"])
    return found.groupBy("page_id", "job_id").agg(F.min_by("token", "pos").alias("token"))
