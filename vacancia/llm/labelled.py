"""Bounded samples of labelled rows on which a classifier is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_bytes: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_class[y] training rows of each class y, drawn by a
    hash of the id; rows held out, null labels and texts of more than max_bytes are left
    out. The bound is the number of rows times max_bytes, whatever the size of the tables."""
    known = labels.select(F.col("doc_id").cast("long").alias("s_id"), F.col(label).cast("int").alias("s_label")).where(F.col("s_label").isin(*per_class) & ~held_out(F.col("s_id"))).groupBy("s_id").agg(F.max("s_label").alias("s_label"))
    order = F.xxhash64("s_id", F.lit(seed))
    drawn = [r for y, n in per_class.items() for r in known.where(F.col("s_label") == y).orderBy(order, "s_id").limit(n).collect()]
    if not drawn:
        return [], []
    # At most sum(per_class) ids, so the broadcast is bounded.
    few = docs.sparkSession.createDataFrame(drawn, "s_id long, s_label int")
    own = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("d_text")).where(F.octet_length("d_text") <= max_bytes)
    # Of rows of one id the text of the least hash, so that the sample depends on the tables alone.
    rows = own.join(F.broadcast(few), F.col("d_id") == F.col("s_id")).groupBy("s_id", "s_label").agg(F.min_by("d_text", F.struct(F.xxhash64("d_text"), "d_text")).alias("s_text")).collect()
    rows.sort(key=lambda r: r["s_id"])
    return [r["s_text"] for r in rows], [r["s_label"] for r in rows]
