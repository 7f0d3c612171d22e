"""Landed payloads of job boards: JSON text to posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..operators.filters import location_matches, title_has_phrase
from ..schema import DETAIL_KEYS

GREENHOUSE = "struct<id:string,title:string,location:struct<name:string>,isListed:boolean,updated_at:string,content:string,absolute_url:string>"
LEVER = "struct<id:string,text:string,categories:struct<location:string>,createdAt:bigint,hostedUrl:string,applyUrl:string,descriptionPlain:string,description:string>"
ASHBY = "struct<id:string,isListed:boolean,title:string,location:string,publishedAt:string,jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string>"


def jobs(df: DataFrame, shape: str, payload: str = "payload") -> DataFrame:
    """One row per job object of each payload, with its position. Elements that are no
    objects, and payloads that do not parse, are dropped; elements are parsed one by one, so
    a bad one does not spoil its payload."""
    schema = {"greenhouse": GREENHOUSE, "lever": LEVER, "ashby": ASHBY}[shape]
    items = F.from_json(payload, "array<string>") if shape == "lever" else F.from_json(payload, "struct<jobs:array<string>>")["jobs"]
    each = df.select(*(c for c in df.columns if c != payload), F.posexplode(items).alias("pos", "_item")).where(F.startswith(F.ltrim("_item"), F.lit("{")))
    return each.withColumn("job", F.from_json("_item", schema)).drop("_item").where("job is not null")


def _row(company: Column, source: str, **c: Column) -> list[Column]:
    values = {"title": X.strip(X.text(c["title"])), "company": company, "location": F.coalesce(X.filled(X.strip(X.text(c["location"]))), F.lit("Unknown")), "url": X.strip(X.text(c["url"])), "source": F.lit(source), "apply_type": F.lit("external"), "job_id": X.text(c["job_id"]), "posted_time": X.text(c["posted_time"]), "job_description": c["job_description"]}
    return [v.alias(k) for k, v in values.items()]


def postings(df: DataFrame, shape: str, token: str = "token", phrases: list[str] | None = None, places: list[str] | None = None) -> DataFrame:
    """Posting rows of payloads, filtered by title phrases and places; the date follows the
    precedence of each source. Unlisted jobs and jobs without a title or URL are dropped."""
    j = F.col("job")
    company = X.company_from_slug(F.col(token))
    rows = jobs(df, shape)
    keep = ["payload_id"] if "payload_id" in df.columns else []
    if shape == "greenhouse":
        url = F.coalesce(X.filled(j["absolute_url"]), F.when(j["id"].isNotNull(), F.concat(F.lit("https://job-boards.greenhouse.io/"), F.col(token), F.lit("/jobs/"), j["id"])))
        cols = _row(company, shape, title=j["title"], location=j["location"]["name"], url=url, job_id=j["id"], posted_time=dates.posted_text(j["updated_at"]), job_description=X.clip(X.html_text(j["content"]), 8000))
        rows = rows.where(F.coalesce(j["isListed"], F.lit(True)))
        place = j["location"]["name"]
    elif shape == "lever":
        day = F.date_format(F.timestamp_millis(j["createdAt"]), "yyyy-MM-dd")
        cols = _row(company, shape, title=j["text"], location=j["categories"]["location"], url=F.coalesce(X.filled(j["hostedUrl"]), j["applyUrl"]), job_id=j["id"], posted_time=day, job_description=X.clip(F.coalesce(X.filled(j["descriptionPlain"]), X.html_text(j["description"])), 8000))
        place = j["categories"]["location"]
    else:
        cols = _row(company, shape, title=j["title"], location=j["location"], url=F.coalesce(X.filled(j["jobUrl"]), j["applyUrl"]), job_id=j["id"], posted_time=dates.posted_text(j["publishedAt"]), job_description=X.clip(X.html_text(F.coalesce(X.filled(j["descriptionHtml"]), j["descriptionPlain"])), 8000))
        rows = rows.where(F.coalesce(j["isListed"], F.lit(True)))
        place = j["location"]
    title = j["text"] if shape == "lever" else j["title"]
    rows = rows.where(title_has_phrase(title, phrases or []) & location_matches(place, places or []))
    return rows.select(*keep, *cols).where("title <> '' and url <> ''")


def detail_rows(df: DataFrame, payload: str = "payload", gap: str = "\n\n", remote: dict[str, str] | None = None) -> DataFrame:
    """Posting rows of detail JSON {jobResult, companyResult, displayScore}: aliased keys, and
    lines for work model, remote and match score added to the description after gap. remote
    gives the words for true and false; a missing one leaves the line out."""
    v = F.try_parse_json(payload)
    both = {"job": ("jobResult", "job_result"), "company": ("companyResult", "company_result")}
    parts = df.select(*(c for c in df.columns if c != payload), *(F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in keys)).alias(f"_{n}") for n, keys in both.items()), F.try_variant_get(v, "$.displayScore", "string").alias("_score"))

    def pick(field: str) -> Column:
        of = F.col("_company" if field == "company" else "_job")
        return F.coalesce(*(F.nullif(X.strip(F.try_variant_get(of, f"$.{n}", "string")), F.lit("")) for n in DETAIL_KEYS[field]))

    found = parts.where("_job is not null and _company is not null").withColumns({f"_{k}": pick(k) for k in DETAIL_KEYS})
    say = {"true": "true", "false": "false"} if remote is None else remote
    told = F.coalesce(*(F.when(F.col("_is_remote") == k, F.lit(f"Remote: {w}")) for k, w in say.items()))
    lines = F.concat_ws("\n", F.concat(F.lit("Work model: "), "_work_model"), told, F.concat(F.lit("Jobright match score: "), X.filled(F.col("_score"))))
    posted = F.regexp_replace("_posted_time", r"^(\d{4}-\d{2}-\d{2})\s+(\d{1,2}:\d{2}:\d{2})", "$1T$2")
    values = {k: F.coalesce(f"_{k}", F.lit("Unknown" if k in ("company", "location") else "")) for k in DETAIL_KEYS if k not in ("work_model", "is_remote")}
    values |= {"posted_time": F.coalesce(dates.posted_text(posted), F.lit("")), "job_description": F.concat_ws(gap, "_job_description", F.nullif(lines, F.lit("")))}
    return found.select(*(c for c in df.columns if c != payload), *(c.alias(k) for k, c in values.items())).where("title <> '' and url <> ''")


def reply_rows(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows of a JSON array in reply text: a fenced block, the whole text or {jobs: [..]},
    else the outermost brackets. Rows need a title and a URL."""
    text = X.strip(X.text(F.col(reply)))
    fenced = X.strip(F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1))
    clean = F.when(fenced != "", fenced).otherwise(text)
    item = "array<struct<title:string,company:string,url:string,easy_apply:string>>"
    found = F.coalesce(F.when(F.startswith(clean, F.lit("[")), F.from_json(clean, item)), F.when(F.startswith(clean, F.lit("{")), F.from_json(clean, f"struct<jobs:{item}>")["jobs"]), F.from_json(F.regexp_extract(clean, r"(\[[\s\S]*\])", 1), item))
    easy = F.lower(X.strip(F.col("job.easy_apply")))
    rows = df.select(*(c for c in df.columns if c != reply), F.posexplode(found).alias("pos", "job"))
    cols = [X.strip(X.text(F.col(f"job.{c}"))).alias(c) for c in ("title", "company", "url")]
    return rows.select(*(c for c in df.columns if c != reply), "pos", *cols, F.when(easy.isin("true", "1", "yes"), True).when(easy.isin("false", "0", "no"), False).alias("easy_apply")).where("title <> '' and url <> ''")


def reply_decisions(df: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """keys, position, keep: lines 'N YES' or 'N NO'; the last line of a number wins."""
    lines = df.select(*keys, F.posexplode(F.split(X.text(F.col(reply)), r"\r?\n")).alias("line_no", "line"))
    m = r"(?i)^\s*(\d+)\s*[:.)-]?\s*(YES|NO)\b"
    hit = lines.where(F.col("line").rlike(m)).select(*keys, "line_no", F.regexp_extract("line", m, 1).try_cast("int").alias("position"), (F.upper(F.regexp_extract("line", m, 2)) == "YES").alias("keep"))
    return hit.groupBy(*keys, "position").agg(F.max_by("keep", "line_no").alias("keep"))
