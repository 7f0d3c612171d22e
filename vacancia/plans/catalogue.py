"""The registry of queries: a name, a callable on (spark, sf_dir) and its oracle SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import view, with_views

AS_OF = "2000-01-01 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder for a query that writes: below spark.checkpoint.dir, which driver and
    executors share, or a temporary one where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    _made.append(f"{root.rstrip('/')}/work-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


def remove_work(spark: SparkSession) -> int:
    """Delete the folders that queries have written in this session, once their results have been
    stored; returns how many there were."""
    paths, _made[:] = _made[:], []
    deleted = 0
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        deleted += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return deleted


def query(sql: str | None, *views: str, hint: str = ""):
    """Register f(view, ...) under its name; the views are passed in order, with a hint for their joins."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v, hint) for v in views))

        QUERIES[f.__name__] = run
        if sql is not None:
            named = [v for v in views if v in _fixture_names()]
            ORACLE_SQL[f.__name__] = with_views(sql, *named) if named else sql
        return f

    return register


def _fixture_names() -> set[str]:
    from ..fixtures import VIEWS

    return set(VIEWS)
