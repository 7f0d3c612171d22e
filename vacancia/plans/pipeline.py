"""The two pipelines: a run over collected rows, and board enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, filters, joins
from ..schema import Params
from ..sources import history, pages


def run(sources: dict[str, DataFrame], stored: DataFrame, params: Params, as_of: str, replies: DataFrame | None = None) -> DataFrame:
    """Rows to append: union of the sources, cheap filters, model decisions, merge across
    sources, then URLs unseen in the window, first per URL. One lazy plan with two shuffles."""
    p = params.clamped()
    rows = history.union_sources(sources)
    phrases = [x for r in p.roles for x in _phrases(r)]
    rows = rows.where(filters.title_has_phrase(F.col("title"), phrases) & filters.location_matches(F.col("location"), list(p.locations)))
    rows = filters.without_reposts(filters.without_easy_apply(rows, p.include_easy_apply), p.include_reposts)
    rows = filters.recent(rows, as_of, p.max_age_days)
    if replies is not None:
        rows = joins.decisions(rows, replies, ["row_id"])
    merged = dedup.cross_source(rows).drop("merged_rows")
    fresh = joins.unseen(merged, stored, as_of, p.dedup_days).where(~X.is_blank(F.col("url")))
    return filters.first_per(fresh, ["url"], ["row_id"])


def _phrases(role: str) -> list[str]:
    """The phrases of one role from the settings, by the same rules as X.role_phrases."""
    out: list[str] = []
    for branch in role.replace("|", ",").split(","):
        words = " ".join(branch.split()).lower()
        left, slash, right = (x.strip() for x in words.partition("/"))
        first, _, rest = right.partition(" ")
        found = [f"{left} {rest}", f"{first} {rest}"] if slash and left and " " not in left and rest else [" ".join(words.replace("/", " ").split())]
        out += [x for x in found if x and x not in out]
    return out


def enrichment(rows: DataFrame, page_table: DataFrame, board: DataFrame, as_of: str) -> DataFrame:
    """Work selection, page patches and date cascade, then the board merge."""
    work = filters.work_selection(rows).drop("platform", "is_listing")
    return joins.expand_boards(pages.enrich(work, page_table, as_of), board)
