"""Posted dates, relative phrases, freshness and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, strip, text


def posted_instant(c: Column) -> Column:
    """UTC instant (timestamp_ntz) of an ISO date or date-time, else null. A date followed
    by anything but 'T' or an offset counts as that midnight."""
    s = strip(text(c))
    return _instant(s, F.regexp_extract(s, DATE, 1), *(F.regexp_extract(s, DATE_TIME, i) for i in (1, 2, 3)))


DATE = r"^(\d{4}-\d{2}-\d{2})"
DATE_TIME = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:?\d{2})?$"


def _instant(s: Column, date: Column, day: Column, time: Column, offset: Column) -> Column:
    """The instant of a stripped text whose parts have been cut out."""
    clock = F.when(F.char_length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    zone = F.when(offset.isin("", "Z"), F.lit("+00:00")).otherwise(F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int"))
    naive = F.call_function("try_to_timestamp", F.concat_ws(" ", day, clock)).cast("timestamp_ntz")
    instant = F.when(day != "", naive - F.make_dt_interval(mins=minutes))
    midnight = F.call_function("try_to_timestamp", date, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return F.when(F.contains(s, F.lit("T")) | s.rlike(r"^\d{4}-\d{2}-\d{2}[+-]"), instant).when(date != "", midnight)


def trimmed_date(c: Column) -> Column:
    """A date string as it is compared and stored: entities decoded, 80 characters at most."""
    s = strip(c.cast("string"))
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(value))
    return F.substring(s, 1, 80)


def posted_text(c: Column) -> Column:
    """The trimmed string where it parses, else null. The string and its parts are bound once,
    and cut out only where it begins with a date."""

    def parsed(v: Column) -> Column:
        s = strip(v)
        parts = F.struct(s.alias("s"), F.regexp_extract(s, DATE, 1).alias("date"), *(F.regexp_extract(s, DATE_TIME, i).alias(n) for i, n in ((1, "day"), (2, "time"), (3, "offset"))))
        instant = once(parts, lambda x: _instant(x["s"], x["date"], x["day"], x["time"], x["offset"]))
        return F.when(s.rlike(DATE), F.when(instant.isNotNull(), v))

    return once(trimmed_date(c), parsed)


def relative_date(c: Column, as_of: Column) -> Column:
    """Date (text) of 'posted 5 days ago' and the like, counted back from as_of."""
    return once(F.lower(text(c)), lambda low: _relative_date(low, as_of))


def _relative_date(low: Column, as_of: Column) -> Column:
    def number(words: str, unit: str) -> Column:
        return F.regexp_extract(low, rf"(?:{words})\s*[:\s,.-]*(\d+)\s+{unit}s?\s+ago", 1)

    def least(n: Column, most: int) -> Column:
        return F.least(n.try_cast("int"), F.lit(most))

    hours, days = number("posted|published|reposted", "hour"), number("posted|published|reposted", "day")
    weeks, months = number("posted|published", "week"), number("posted|published", "month")
    day = F.to_date(as_of)
    found = (
        F.when(hours != "", F.to_date(as_of - F.make_dt_interval(hours=least(hours, 24 * 180)))).when(days != "", F.date_sub(day, least(days, 730)))
        .when(weeks != "", F.date_sub(day, 7 * least(weeks, 104))).when(months != "", F.date_sub(day, 30 * least(months, 24)))
    )
    return found.cast("string")


def freshness(posted: Column, window: str = "24h") -> Column:
    """struct(keep, label) of the text beside a posting. Rules hold in their order."""
    both = lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))
    return once(once(strip(text(posted)), both), lambda x: _freshness(x["t"], x["low"], window))


def _freshness(t: Column, low: Column, window: str) -> Column:
    week = window.lower() in ("week", "1w", "7d", "168h")
    line = F.substring(strip(F.regexp_replace(F.split_part(t, F.lit("\n"), F.lit(1)), r"\s+", " ")), 1, 120)
    repost = F.contains(low, F.lit("reposted"))
    branded = F.concat(F.lit("Reposted — "), line)
    hours = F.coalesce(F.regexp_extract(low, r"(\d+)\s*hours?\s*ago", 1).try_cast("int"), F.when(F.contains(low, F.lit("an hour ago")), 1))
    days = F.regexp_extract(low, r"(\d+)\s*days?\s*ago", 1).try_cast("int")
    weeks = F.regexp_extract(low, r"(\d+)\s+weeks?", 1).try_cast("int")
    out = lambda keep, label: F.struct(F.lit(keep).alias("keep"), label.alias("label"))
    drop, fresh = out(False, F.lit("")), F.when(repost, branded).otherwise("Fresh")
    mine = F.when(repost, branded).otherwise(line)
    return (
        F.when((t == "") | F.contains(low, F.lit("month")) | (weeks >= 1) | F.contains(low, F.lit("one week")), drop)
        .when(F.contains(low, F.lit("minute")), out(True, fresh))
        .when(hours.isNotNull(), F.when(F.lit(not week) & (hours >= 24), drop).otherwise(out(True, F.when(repost, branded).when(hours < 3, "Fresh").otherwise(line))))
        .when(low.rlike(r"an hour|\b1\s*hour\b"), out(True, fresh))
        .when(days.isNotNull(), F.when(F.lit(week) & (days <= 7), out(True, mine)).otherwise(drop))
        .when(F.contains(low, F.lit("yesterday")) & F.lit(week), out(True, mine))
        .otherwise(drop)
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def duration_text(c: Column) -> Column:
    """'3.5s', '42s', '2m 5s'; a dash for null."""
    tenths = F.regexp_replace(F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10), r"\.0$", "")
    whole = lambda x: F.floor(x + 0.5).cast("string")
    minutes = F.floor(c / 60)
    return F.when(c.isNull(), "—").when((c > 0) & (c < 10), F.concat(tenths, F.lit("s"))).when(c < 60, F.concat(whole(c), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), whole(c - minutes * 60), F.lit("s")))


def relative_time(c: Column, as_of: Column) -> Column:
    """'3 days ago', 'in 2 hours', 'yesterday': the distance of an instant from as_of."""
    js = lambda x: F.floor(x + 0.5)
    sec = js((F.unix_micros(c.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 1e6)
    minute, hour, day = js(sec / 60), js(js(sec / 60) / 60), js(js(js(sec / 60) / 60) / 24)

    def say(n: Column, unit: str, now: str) -> Column:
        s = F.when(F.abs(n) == 1, unit).otherwise(unit + "s")
        number = F.abs(n).cast("string")
        words = F.when(n == 0, now).when(n < 0, F.concat(number, F.lit(" "), s, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), number, F.lit(" "), s))
        return F.when(n == -1, "yesterday").when(n == 1, "tomorrow").otherwise(words) if unit == "day" else words

    return F.when(c.isNull(), "").when(F.abs(sec) < 60, say(sec, "second", "now")).when(F.abs(minute) < 60, say(minute, "minute", "this minute")).when(F.abs(hour) < 24, say(hour, "hour", "this hour")).otherwise(say(day, "day", "today"))
