"""Filters and projections over postings. Column names are parameters where they vary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..schema import DASHBOARD_LABELS, PLATFORM_RANK, REPORT_COLUMNS, REPORT_LABELS, SKIPPED_PLATFORMS


def found_between(df: DataFrame, since=None, after=None, before=None, until=None, at: str = "found_at", day: str = "found_date") -> DataFrame:
    """Rows found at or after `since`, strictly after `after`, strictly before `before`, at or
    before `until` (each a text or a constant column). Where the table has its partition column
    `day`, the day of `at`, the same bounds hold for that, so that only their partitions are
    listed and read."""
    bounds = [(c if isinstance(c, Column) else F.lit(c).cast("timestamp_ntz"), test, low) for c, test, low in ((since, "__ge__", True), (after, "__gt__", True), (before, "__lt__", False), (until, "__le__", False)) if c is not None]
    for bound, test, low in bounds:
        df = df.where(getattr(F.col(at), test)(bound))
        if day in df.columns:
            df = df.where(F.col(day) >= F.to_date(bound) if low else F.col(day) <= F.to_date(bound))
    return df


def window_start(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max(1, days)))


def history_search(df: DataFrame, source: str | None = None, role: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Conjunction of the given predicates. A bare date_to means the end of that day."""
    if source:
        df = df.where(F.col("source") == source)
    if role:
        df = df.where(F.col("search_role") == role)
    end = F.lit(date_to).cast("timestamp_ntz") if date_to else None
    whole_day = date_to and len(date_to) == 10
    return found_between(df, since=date_from or None, before=end + F.expr("interval 1 day") if whole_day else None, until=None if whole_day else end)


def today(df: DataFrame, as_of: str, source: str | None = None, role: str | None = None) -> DataFrame:
    return history_search(df, source, role, date_from=as_of[:10])


def null_safe(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Strings without nulls: '' or the column's default."""
    defaults = {"apply_type": "unknown"} | (defaults or {})
    return df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(defaults.get(f.name, ""))) for f in df.schema if f.dataType.simpleString() == "string"})


def without_easy_apply(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(X.key(F.col("apply_type")) != "easy_apply")


def age_flag(as_of: str, max_days: int, column: str = "posted_time") -> Column:
    """'kept', 'too_old' or 'unparseable'."""
    at = dates.posted_instant(F.col(column))
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max_days))
    return F.when(F.lit(max_days <= 0), "kept").when(at.isNull(), "unparseable").when(at < cut, "too_old").otherwise("kept")


def recent(df: DataFrame, as_of: str, max_days: int, column: str = "posted_time") -> DataFrame:
    return df.where(age_flag(as_of, max_days, column) == "kept")


def age_counts(df: DataFrame, as_of: str, max_days: int, column: str = "posted_time") -> DataFrame:
    flag = age_flag(as_of, max_days, column)
    return df.agg(*(F.count_if(flag == x).alias(x) for x in ("kept", "too_old", "unparseable")))


def phrases_of(roles: DataFrame, role: str = "role") -> DataFrame:
    """role, phrase: the expanded phrases of a table of roles."""
    return roles.select(F.col(role).alias("role"), F.explode(X.role_phrases(F.col(role))).alias("phrase")).distinct()


def title_has_phrase(title: Column, phrases: list[str]) -> Column:
    """Whether the title contains one of a few phrases known when planning; no phrases keep all."""
    if not phrases:
        return F.lit(True)
    return (X.normal(title) != "") & reduce(lambda a, b: a | b, (F.contains(X.normal(title), F.lit(p)) for p in phrases))


def location_matches(location: Column, searches: list[str]) -> Column:
    """Substring of any search; us, usa and united states also match 'united states'."""
    if not searches:
        return F.lit(True)
    low = X.key(location)
    wanted = list(dict.fromkeys(q for s in searches if s.strip() for q in (s.strip().lower(), *(("united states",) if s.strip().lower() in ("us", "usa", "united states") else ()))))
    return (low != "") & reduce(lambda a, b: a | b, (F.contains(low, F.lit(q)) for q in wanted))


def soft_role_filter(df: DataFrame, groups: list[str], role: str = "search_role") -> DataFrame:
    """Rows whose title or company has a role token of 3 or more characters; a group in
    which none has keeps all its rows."""
    tokens = F.filter(F.split(X.key(F.col(role)), r"[\s,/+._-]+"), lambda t: F.char_length(t) >= 3)
    blob = F.lower(F.concat_ws(" ", X.text(F.col("title")), X.text(F.col("company"))))
    flagged = df.withColumn("_hit", F.exists(tokens, lambda t: F.contains(blob, t)))
    # The group's flag comes from an aggregate with few rows, not from a window over whole groups.
    found = flagged.groupBy(*groups).agg(F.bool_or("_hit").alias("_any")).withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups))
    return flagged.join(found, same).where("_hit or not _any").drop("_hit", "_any", *(f"_g_{g}" for g in groups))


def enabled_keys(keys: DataFrame, toggles: DataFrame, key: str = "key") -> DataFrame:
    """Enabled keys (missing: enabled); if none is, all of them. toggles: key, enabled."""
    joined = keys.join(toggles.select(F.col("key").alias("_k"), "enabled"), F.col(key) == F.col("_k"), "left").withColumn("_on", F.coalesce("enabled", F.lit(True)))
    any_on = joined.agg(F.coalesce(F.bool_or("_on"), F.lit(False)).alias("_any_on"))  # one row
    return joined.join(F.broadcast(any_on), F.col("_on") | ~F.col("_any_on")).select(*keys.columns)


def platform_split(df: DataFrame, url: str = "url") -> DataFrame:
    """df with platform and skipped."""
    return df.withColumn("platform", X.platform(F.col(url))).withColumn("skipped", F.col("platform").isin(*SKIPPED_PLATFORMS))


def without_reposts(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(~F.startswith(X.text(F.col("freshness")), F.lit("Reposted —")))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines early; by a
    plain minimum where nothing else is asked for."""
    if len(order) == 1 and sorted(df.columns) == sorted([*keys, *order]):
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*df.columns)
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(row.alias("_row")).select("_row.*")


def work_selection(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Known-platform rows that lack a date or a description, first per URL, with listing
    pages marked."""
    need = df.withColumn("platform", X.platform(F.col("url"))).where((F.col("platform") != "") & ~F.col("platform").isin(*SKIPPED_PLATFORMS) & (X.is_blank(F.col("posted_time")) | X.is_blank(F.col("job_description"))))
    return first_per(need, ["url"], [order]).withColumn("is_listing", X.is_listing_page(F.col("url")))


def priority(platform: Column) -> Column:
    return F.coalesce(*(F.when(platform == k, v) for k, v in PLATFORM_RANK.items()), F.lit(6))


def by_priority(df: DataFrame, order: str = "row_id") -> DataFrame:
    return df.withColumn("rank", priority(X.platform(F.col("url")))).orderBy("rank", order)


def report(df: DataFrame) -> DataFrame:
    """The 14 report columns."""
    apply_key = X.key(F.col("apply_type"))
    values = {c: X.text(F.col(c)) if c in df.columns else F.lit("") for c in ("title", "company", "location", "salary", "employment_type", "seniority", "freshness", "posted_time", "applicant_count", "job_id", "url")}
    label = F.when(apply_key == "easy_apply", "Easy Apply").when(apply_key == "external", "External").otherwise(apply_key)
    source = X.labelled(F.col("source"), REPORT_LABELS, F.coalesce(X.filled(F.col("source")), F.lit("Unknown")))
    found = F.date_format("found_at", "yyyy-MM-dd'T'HH:mm:ss")
    order = [*(values[c] for c in ("title", "company", "location", "salary", "employment_type", "seniority", "freshness", "posted_time", "applicant_count")), label, source, values["job_id"], values["url"], F.coalesce(found, F.lit(""))]
    return df.select(*(c.alias(n) for c, n in zip(order, REPORT_COLUMNS)))


def dashboard(df: DataFrame, order: str = "row_id") -> DataFrame:
    fresh, d = X.text(F.col("freshness")), X.text(F.col("job_description"))
    style = F.when(fresh == "Fresh", "freshness-cell freshness-cell--fresh").when(fresh.isin("1 day ago", "2 days ago"), "freshness-cell freshness-cell--recent").when(F.startswith(fresh, F.lit("Reposted")), "freshness-cell freshness-cell--reposted").otherwise("freshness-cell")
    return df.select(order, X.labelled(F.col("source"), DASHBOARD_LABELS, X.text(F.col("source"))).alias("source_name"), style.alias("freshness_class"), F.when(F.char_length(d) > 200, F.concat(F.substring(d, 1, 197), F.lit("…"))).otherwise(d).alias("preview"))


def page_flags(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    low, u = F.lower(X.text(F.col(html))), F.lower(X.text(F.col(url)))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    flags = {
        "captcha": has("captcha", "unusual traffic", "are you a robot"),
        "login_wall": F.contains(u, F.lit("/login")) | F.contains(u, F.lit("/authwall")) | has("sign in to continue"),
        "challenge": F.contains(u, F.lit("/checkpoint")) | has("security verification"),
        "no_results": has("no matching jobs found", "no results found", "did not match any"),
    }
    return pages.withColumns(flags).withColumn("usable", ~reduce(lambda a, b: a | b, flags.values()))


def capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each key; the cap is the operator's meaning."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
