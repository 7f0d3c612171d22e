"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The
first three drop rows, the fourth rewrites texts, the last packs token pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, minhash, quality, queries, secrets
from vacancia.llm.shared import read_table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score >= 0.3). Rows without an
    id stay or go by their text like others, null and empty texts are scored as empty ones, long
    texts are scored whole, equal rows get equal scores; an empty table stays empty, and where no
    label can be learnt from nothing is rejected. All columns are kept, whatever their names."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least by id and hash of the text. Rows
    alike in id and text count once (the least of their other columns stays), rows of one id
    with unlike texts all stay, and so do rows without an id, without text or words."""
    found = minhash.near_duplicates(docs).where("doc_id = component_id and text_hash = component_hash")
    kept = found.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = docs.select(F.col("doc_id").alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("row_hash") == F.col("kept_hash")), "left_semi").groupBy("row_id", "row_hash").agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null texts and those without words have none and
    stay; long texts are searched whole, repeated rows each by itself; an empty table or an empty
    benchmark drops nothing. All columns are kept, whatever their names."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by the name of their kind; where spans overlap, one
    name stands for all. n_chars follows a changed text. Null and empty texts and texts without
    secrets stay as they are, rows without an id and repeated rows are each treated by their
    text; an empty table stays empty. All columns are kept, whatever their names."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in sequences of at most 1024. Null and empty texts
    give their end id, long texts full pieces and a rest, repeated rows are packed each, null ids
    stay null; an empty table gives no piece. Other columns are not read."""
    return queries.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", packing),
]

#: The classifier's scores and the packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
