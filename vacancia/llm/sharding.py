"""Operator 5: shards by sampled splitters, with DataFrame functions only.

Rows get the composite key (hash of the text, id, position), so equal texts are
neighbours, yet a group of copies of any size can be divided. Size-weighted samples of the
keys give quantile boundaries of `shards * cells` ranges; ranges whose exact bytes exceed
`overfull` times the mean are sampled anew and subdivided until none that holds more than
one row is left (or `rounds` are over). Consecutive ranges then go to shards by their exact
cumulative bytes. Only samples (at most about `samples` keys a round) and one row for each
range reach the driver; neither grows with the data.

Slots: rows are range-partitioned and sorted by (shard, key), a written table keeps each
row's partition and position, and the counts before each (shard, partition) make the slots
gapless without gathering a shard in one task.

Defined cases: a null text has size 1 and crc 0; a very long text is one row, so a shard can
exceed the mean by its size; repeated rows and null ids are rows like others, and ties in
the key are told apart by the row's position; an empty table gives no row; other columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, range_number, written

KEY = ("key_hash", "key_id", "key_row")


def _below(splitters: list[tuple[int, int, int]]) -> Column:
    return range_number([F.col(c) for c in KEY], splitters)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = 32, samples: int = 40_000, overfull: float = 1.5, rounds: int = 6, seed: int = 11) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key_hash"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key_id"), F.monotonically_increasing_id().alias("key_row"),
        ),
        "shard-keys",
    )
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("size")).first()
    want = shards * cells
    mean = max(1.0, total / want)

    def sampled(part: DataFrame, size: int, pieces: int) -> list[tuple[int, int, int]]:
        """Boundaries at the quantiles of a sample in which a row's chance follows its size."""
        drawn = part.where(F.rand(seed) * size < F.col("size") * float(min(samples, 256 * pieces))).select(*KEY, "size").collect()
        keys = sorted(tuple(x[:3]) for x in drawn)
        return sorted({keys[len(keys) * i // pieces] for i in range(1, pieces)}) if keys else []

    splitters = sampled(rows, total, want) if total else []
    for left in reversed(range(rounds + 1)):  # found always describes the ranges of splitters
        ranged = rows.withColumn("cell", _below(splitters))
        found = ranged.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
        heavy = [x for x in found if x["bytes"] > overfull * mean and x["n"] > 1 and x["largest"] < 0.9 * x["bytes"]]
        if not heavy or not left:
            break
        new = set(splitters)
        over = sum(x["bytes"] for x in heavy)
        part = ranged.where(F.col("cell").isin([x["cell"] for x in heavy]))
        new |= set(sampled(part, over, min(4 * want, 2 + int(2 * over / mean))))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)

    before, owner = 0, {}
    for x in sorted(found, key=lambda x: x["cell"]) if total else []:
        owner[x["cell"]] = min(shards - 1, int((before + x["bytes"] / 2) * shards / total))
        before += x["bytes"]
    by_cell = F.array(*(F.lit(owner.get(i, 0)) for i in range(len(splitters) + 1)))
    placed = rows.withColumn("shard", F.get(by_cell, _below(splitters)))
    order = ("shard", *KEY)
    numbered = written(
        placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "position": F.monotonically_increasing_id()}).select("doc_id", "size", "text_crc32", "shard", "part", "position"),
        "shard-rows",
    )
    # One row for each partition of each shard.
    runs = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slot = (F.col("base") + F.col("position") - F.col("first")).cast("long")
    return numbered.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
