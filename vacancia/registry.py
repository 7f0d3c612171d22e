"""All registered queries by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .operators import dedup, filters, stats
from .plans import catalogue
from .plans import history_queries, text_queries  # noqa: F401  (the queries register themselves)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role filter, cross-source merge, statistics: kind, name, n."""
    rows = fixtures.view(spark, sf_dir, "postings", fixtures.ALL_BY_HASH)
    kept = rows.where(filters.title_has_phrase(F.col("title"), ["ring", "widget", "bolt"]))
    return stats.bundle(dedup.cross_source(kept).drop("merged_rows"), catalogue.AS_OF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES) | {"flagship": flagship}


FLAGSHIP = f"""WITH p AS (SELECT *, {history_queries.KEYED} FROM postings WHERE contains(lower(title), 'ring') OR contains(lower(title), 'widget') OR contains(lower(title), 'bolt')),
w AS (SELECT arg_max(row_id, ({history_queries.RICH}, -row_id)) AS row_id FROM p WHERE t <> '' AND c <> '' GROUP BY t, c UNION ALL SELECT row_id FROM p WHERE t = '' OR c = ''),
m AS (SELECT DISTINCT p.row_id, p.source, p.search_role, p.found_at FROM p JOIN w ON p.row_id = w.row_id)
SELECT 'total' AS kind, '' AS name, count(*) AS n FROM m UNION ALL SELECT 'today', '', count(*) FROM m WHERE found_at >= TIMESTAMP '2000-01-01' UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY source UNION ALL SELECT 'role', coalesce(search_role,'Unknown'), count(*) FROM m GROUP BY 2"""


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLE_SQL) | {"flagship": fixtures.with_views(FLAGSHIP, "postings")}
