"""Schemas, fixed labels and parameters of the postings model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Names, labels and lists that results depend on.
CANONICAL = ("title", "company", "url", "source", "apply_type", "search_role", "search_location", "location", "job_id", "posted_time", "freshness", "applicant_count", "job_description", "seniority", "salary", "employment_type")
SOURCES = ("linkedin", "indeed", "ats", "jobright", "yc", "career_page")
PLATFORM_HOSTS = {"greenhouse.io": "greenhouse", "lever.co": "lever", "ashbyhq.com": "ashby", "smartrecruiters.com": "smartrecruiters", "workable.com": "workable", "myworkdayjobs.com": "workday", "jobvite.com": "jobvite", "bamboohr.com": "bamboohr", "icims.com": "icims"}
SKIPPED_PLATFORMS = ("workday", "icims")
PLATFORM_RANK = {"greenhouse": 0, "lever": 1, "ashby": 2, "smartrecruiters": 3, "workable": 4}
REPORT_LABELS = {"linkedin": "LinkedIn", "indeed": "Indeed", "ats": "ATS", "jobright": "Jobright AI", "greenhouse": "Greenhouse", "yc": "YC", "career_page": "Career Pages"}
DASHBOARD_LABELS = {"linkedin": "LinkedIn", "indeed": "Indeed", "ats": "ATS", "greenhouse": "Greenhouse", "lever": "Lever", "ashby": "Ashby", "smartrecruiters": "SmartRecruiters", "workable": "Workable", "workday": "Workday", "jobvite": "Jobvite", "bamboohr": "BambooHR", "icims": "iCIMS", "yc": "YC", "career_page": "Career Page", "jobright": "Jobright AI"}
EMPLOYMENT_LABELS = {"fulltime": "Full-time", "parttime": "Part-time", "contract": "Contract", "internship": "Internship", "temporary": "Temporary"}
DEFAULT_PHRASES = ("software engineer", "data scientist", "data analyst", "product manager")
GENERIC_LOCATIONS = ("remote", "united states", "usa", "us", "anywhere", "worldwide", "hybrid", "on-site", "onsite", "on site")
LISTING_SUFFIXES = ("/careers", "/jobs", "/open-positions", "/openings", "/job-openings")
NEXT_DATE_KEYS = ("dateposted", "publisheddate", "published_at", "publishedat", "firstpublishedat", "first_published_at", "postedat", "posted_at", "publicationstartdate", "jobposteddate", "updated_at", "updatedat", "created_at", "createdat")
META_DATES = ("article:published_time", "og:published_time", "og:updated_time", "date")
PAY_KEYS = ("pay_buckets_display", "pay_transparency_display", "pay_transparency_description", "salary_range", "compensation")
ADDRESS_PARTS = ("addressLocality", "addressRegion", "addressCountry")
CONTAINERS = (
    r"<div\b[^>]*jobs-description-content__text[^>]*>([\s\S]*?)</div>", r"<div\b[^>]*jobs-description__text[^>]*>([\s\S]*?)</div>", r"<div\b[^>]*jobs-box__html-content[^>]*>([\s\S]*?)</div>",
    r"<div\b[^>]*class=[\"'][^\"']*job-description[^>]*>([\s\S]*?)</div>", r"<div\b[^>]*class=[\"'][^\"']*JobDescription[^>]*>([\s\S]*?)</div>", r"<[a-z]+\b[^>]*id=[\"']job-description[\"'][^>]*>([\s\S]*?)</",
    r"<div\b[^>]*data-job-description[^>]*>([\s\S]*?)</div>", r"<article\b[^>]*job-description[^>]*>([\s\S]*?)</article>", r"<div\b[^>]*id=[\"']content[\"'][^>]*>([\s\S]*?)</div>", r"<main\b[^>]*>([\s\S]*?)</main>",
)
DETAIL_KEYS = {
    "title": ("jobTitle", "job_title", "title"), "company": ("companyName", "company_name", "name"), "url": ("originalUrl", "original_url", "applyLink", "apply_link", "applyUrl", "apply_url", "externalUrl", "external_url"),
    "location": ("jobLocation", "job_location", "location"), "posted_time": ("publishTime", "publish_time"), "freshness": ("publishTimeDesc", "publish_time_desc"), "salary": ("salaryDesc", "salary_desc", "salary"),
    "employment_type": ("employmentType", "employment_type"), "seniority": ("jobSeniority", "job_seniority", "seniority"), "work_model": ("workModel", "work_model"), "job_description": ("jobSummary", "job_summary", "summary"),
    "job_id": ("jobId", "job_id", "id"), "applicant_count": ("applicantsCount", "applicants_count"), "is_remote": ("isRemote",),
}
REPORT_COLUMNS = ("Title", "Company", "Location", "Salary", "Employment Type", "Seniority", "Freshness", "Posted", "Applicants", "Apply Type", "Source", "Job ID", "Apply Link", "Found At")

POSTING = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in CANONICAL), T.StructField("found_at", T.TimestampNTZType())])

RUN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("finished_at", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("jobs_found", T.IntegerType()),
        T.StructField("errors", T.StringType()),
        T.StructField("duration_sec", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Params:
    """Settings of a run; limits are those of the settings page."""

    roles: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    include_easy_apply: bool = False
    include_reposts: bool = False
    dedup_days: int = 7
    max_age_days: int = 0
    retention_days: int = 30
    pages: int = 20
    batch_rows: int = 24
    source_group: dict[str, str] = field(default_factory=lambda: dict.fromkeys(PLATFORM_HOSTS.values(), "ats"))

    def clamped(self) -> "Params":
        clamp = lambda x, low, high: max(low, min(high, x))
        return Params(**{**self.__dict__, "dedup_days": clamp(self.dedup_days, 1, 365), "max_age_days": clamp(self.max_age_days, 0, 365), "pages": clamp(self.pages, 1, 50), "retention_days": max(1, self.retention_days)})
