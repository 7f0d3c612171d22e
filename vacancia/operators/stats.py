"""Counts, summaries and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SOURCES


def by_source(df: DataFrame) -> DataFrame:
    return df.where(~X.is_blank(F.col("source"))).groupBy("source").agg(F.count("*").alias("n"))


def by_role(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(X.filled(F.col("search_role")), F.lit("Unknown")).alias("role")).agg(F.count("*").alias("n"))


def bundle(df: DataFrame, as_of: str) -> DataFrame:
    """total, today, by source and by role from one scan: kind, name, n."""
    day = F.lit(as_of[:10]).cast("timestamp_ntz")
    parts = df.select(F.coalesce(X.filled(F.col("source")), F.lit("")).alias("source"), F.coalesce(X.filled(F.col("search_role")), F.lit("Unknown")).alias("role"), (F.col("found_at") >= day).alias("is_today"))
    sets = parts.groupingSets([[], ["source"], ["role"]], "source", "role").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("is_today").alias("n_today"))
    kind = F.when(F.col("g") == 3, F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name"), F.col("n")), F.struct(F.lit("today").alias("kind"), F.lit("").alias("name"), F.col("n_today").alias("n"))))
    kind = kind.when(F.col("g") == 1, F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("name"), F.col("n")))).otherwise(F.array(F.struct(F.lit("role").alias("kind"), F.col("role").alias("name"), F.col("n"))))
    return sets.select(F.inline(kind)).where("not (kind = 'source' and name = '')")


def bundle_of_counts(counts: DataFrame, as_of: str) -> DataFrame:
    """bundle from partial counts: found_date, source ('' for none), role, n."""
    today = F.col("found_date") >= F.to_date(F.lit(as_of[:10]))
    sets = counts.groupingSets([[], ["source"], ["role"]], "source", "role").agg(F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum(F.when(today, F.col("n"))).alias("n_today"))
    one = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.coalesce(n, F.lit(0)).alias("n"))
    kind = F.when(F.col("g") == 3, F.array(one("total", F.lit(""), F.col("n")), one("today", F.lit(""), F.col("n_today"))))
    kind = kind.when(F.col("g") == 1, F.array(one("source", F.col("source"), F.col("n")))).otherwise(F.array(one("role", F.col("role"), F.col("n"))))
    return sets.select(F.inline(kind)).where("not (kind = 'source' and name = '')")


def zero_filled(df: DataFrame, source_group: dict[str, str] | None = None) -> DataFrame:
    """Counts of the six sources in fixed order; source_group maps platforms to a source."""
    source = X.labelled(F.col("source"), source_group, F.col("source")) if source_group else F.col("source")
    counts = df.groupBy(source.alias("_s")).agg(F.count("*").alias("_n"))
    fixed = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SOURCES)], "pos int, source string")
    return F.broadcast(fixed).join(counts, F.col("source") == F.col("_s"), "left").select("pos", "source", F.coalesce("_n", F.lit(0)).alias("n"))


def run_summary(found: DataFrame, new: DataFrame) -> DataFrame:
    """found and new rows of each source and in total."""
    tagged = found.select("source", F.lit(0).alias("is_new")).unionAll(new.select("source", F.lit(1).alias("is_new")))
    return tagged.rollup("source").agg(F.grouping("source").alias("is_total"), F.count_if(F.col("is_new") == 0).alias("n_found"), F.count_if(F.col("is_new") == 1).alias("n_new")).select(F.when(F.col("is_total") == 1, "(all)").otherwise(X.text(F.col("source"))).alias("source"), "n_found", "n_new")


def enrichment_counters(df: DataFrame, extractor: str = "extractor") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(extractor), F.lit("missing")).alias("extractor")).agg(F.count("*").alias("n"))


def widths(df: DataFrame, most: int = 60) -> DataFrame:
    """Width of each column: longest text or heading plus 2, at most `most`."""
    one = df.agg(*(F.greatest(F.max(F.char_length(X.text(F.col(f"`{c}`")))), F.lit(len(c))).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.least(F.coalesce(F.col(f"`{c}`"), F.lit(len(c))) + 2, F.lit(most)).alias("width")) for c in df.columns))
    return one.select(F.inline(pairs))


def board_slugs(df: DataFrame, url: str = "url") -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(p).alias("platform"), X.board_slug(F.col(url), d).alias("slug")) for p, d in (("greenhouse", "greenhouse.io"), ("lever", "lever.co"), ("ashby", "ashbyhq.com"))))
    return df.select(F.inline(pairs)).where("slug <> ''").distinct()


def markup_profile(pages: DataFrame, patterns: dict[str, str], html: str = "html", url: str = "url") -> DataFrame:
    """Per host: pages, pages with any hit, and hits of every pattern."""
    counted = pages.select(X.host(F.col(url)).alias("host"), *(F.regexp_count(F.col(html), F.lit(p)).alias(n) for n, p in patterns.items()))
    hit = sum((F.col(n) for n in patterns), F.lit(0)) > 0
    return counted.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(hit).alias("n_with_hits"), *(F.sum(n).alias(n) for n in patterns))


def newest(df: DataFrame, limit: int, offset: int = 0, at: str = "found_at", order: str = "row_id") -> DataFrame:
    """A page of the newest rows; the limit (1..500) is the operator's meaning."""
    return df.orderBy(F.desc(at), F.desc(order)).offset(max(0, offset)).limit(max(1, min(500, limit)))


def removed(before: DataFrame, after: DataFrame, key: str = "row_id") -> DataFrame:
    return before.join(after.select(key), key, "left_anti")


def newest_per(df: DataFrame, keys: dict, value: str, order: list[str]) -> DataFrame:
    """value of the newest row of each key; keys gives name and expression."""
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.max_by(value, F.struct(*order)).alias(value))
