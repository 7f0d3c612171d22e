"""Operator 13: a Merkle manifest of a dataset that stores only every few levels.

Leaves are hashes of whole rows. Per source they are numbered in id order; every three
consecutive nodes become their parent until one is left, and the subtrees' roots, in order of
the sources, become the root in the same way. Only every `levels`-th level of nodes is written.
A proof needs the levels between too: nodes are gathered by aligned subtree (3 ** levels of them
at most), which regenerates its inner nodes, gives each stored node its siblings up to the
subtree's top, and is dropped. Going down the stored levels, a node's path is its own part and
its parent's.

Numbering: rows are range-partitioned by (source, id, leaf, place), so a hot source spreads over
many tasks; each numbers its own rows, and counts of the tasks before are added.

Defined cases: a null in a hashed column is `-`, other values carry their length; a null source
is a tree of its own, ordered first; null ids come first, rows of one id are ordered by leaf, and
equal rows have equal leaves, so which comes first changes no hash; long texts are hashed whole;
an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

ARITY = 3


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hashed_rows(docs: DataFrame, columns: tuple[str, ...], key_col: str, id_col: str, tampered: dict[str, Column]) -> DataFrame:
    """key (of the tree), doc_id, leaf, and changed: the leaf with the columns of tampered
    replaced where those differ, else null."""
    old = {c: F.col(f"`{c}`") for c in columns}
    new = old | tampered
    differs = F.lit(False)
    for c in tampered:
        differs = differs | ~old[c].eqNullSafe(new[c])
    leaf, changed = (sha256(F.concat(*(field(v) for v in x.values()))) for x in (old, new))
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{key_col}`").cast("string")), F.lit(""))
    return docs.select(key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(differs, changed).alias("changed"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written with `at`, their place within their key (from 0), and `total`, its rows."""
    key = ["key", *order, "place"]
    ranged = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    stored = written(ranged.drop("place").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name)
    # One row for each key of each partition: a key has as many as there are partitions at most.
    runs = stored.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    every = Window.partitionBy("key")
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(every).alias("total"))
    at = F.col("base") + F.col("row") - F.col("first")
    return stored.join(runs, ["key", "part"]).withColumn("at", at).drop("part", "row", "first", "base")


def up(nodes: Column) -> Column:
    """The parents of consecutive nodes, beginning at a multiple of ARITY."""
    run = lambda i: F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: sha256(run(i)))


def subtrees(nodes: DataFrame, levels: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each aligned subtree: key, block, ends (whether its tree ends in it), total,
    rows (its nodes in order: at, hash and the carried columns) and n0 to n{levels}, the hashes
    level by level; null above the one node at which a tree ends."""
    span = ARITY**levels
    row = F.struct("at", "hash", *carried)
    found = nodes.groupBy("key", F.floor(F.col("at") / span).alias("block"), "total").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = found.withColumns({"ends": F.col("total") <= span, "n0": F.transform("rows", lambda x: x["hash"])})
    for i in range(levels):
        goes_on = F.col(f"n{i}").isNotNull() & (~F.col("ends") | (F.size(f"n{i}") > 1))
        found = found.withColumn(f"n{i + 1}", F.when(goes_on, up(F.col(f"n{i}"))))
    return found


def stored_levels(leaves: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Every `levels`-th level of the trees: key, at, total, hash; each tree ends with its root."""
    found = [leaves]
    while found[-1].where("total > 1").limit(1).count():
        blocks = subtrees(found[-1].where("total > 1"), levels)
        top = F.coalesce(*(F.get(f"n{i}", F.lit(0)) for i in reversed(range(levels + 1))))
        total = F.ceil(F.col("total") / ARITY**levels).cast("long")
        found.append(written(blocks.select("key", F.col("block").alias("at"), total.alias("total"), top.alias("hash")), f"{name}-{len(found)}"))
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """key and hash of the one node at the end of each tree."""
    ends = [x.where("total = 1").select("key", "hash") for x in found]
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out


def paths(found: list[DataFrame], levels: int, over: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row for each leaf of the trees: key, at, hash, its carried columns, the other columns of
    over and its path: for each level, the hashes joined before and after its own. over has a row
    for each tree: key, path (from its root on) and other columns."""
    others = [c for c in over.columns if c not in ("key", "path")]
    tops = over.select(F.col("key").alias("top_key"), F.lit(0).cast("long").alias("top_block"), F.lit(True).alias("top_ends"), F.col("path").alias("top_path"), *others)
    above = None
    inner = [x.where("total > 1") for x in found[1:-1]]
    for nodes in [*reversed(inner), found[0]]:
        own = carried if nodes is found[0] else ()
        parents = tops if above is None else tops.unionByName(above.select(F.col("key").alias("top_key"), F.col("at").alias("top_block"), F.lit(False).alias("top_ends"), F.col("path").alias("top_path"), *others))
        same = (F.col("key") == F.col("top_key")) & (F.col("block") == F.col("top_block")) & (F.col("ends") == F.col("top_ends"))
        blocks = subtrees(nodes, levels, own).join(parents, same)
        steps = []
        for j in range(levels):
            child = F.floor(F.col("local") / ARITY**j).cast("int")
            place = F.pmod(child, F.lit(ARITY))
            run = F.slice(f"n{j}", child - place + 1, F.lit(ARITY))
            step = F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"), F.array_join(F.slice(run, place + 2, F.lit(ARITY)), "").alias("right"))
            steps.append(F.when(F.col(f"n{j + 1}").isNotNull(), step))
        members = blocks.select("*", F.posexplode("rows").alias("local", "node"))
        part = F.filter(F.array(*steps), lambda x: x.isNotNull())
        above = members.select("key", F.col("node.at").alias("at"), F.col("node.hash").alias("hash"), *(F.col(f"node.{c}").alias(c) for c in own), *others, F.concat(part, "top_path").alias("path"))
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda x, s: sha256(F.concat(s["left"], x, s["right"])))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key_col: str = "source", id_col: str = "doc_id", tampered: dict[str, Column] | None = None, levels: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256 (the hash of the
    siblings, level by level), folded_root (from the leaf with the columns of tampered replaced)
    and verified: whether that is the root."""
    leaves = numbered(hashed_rows(docs, columns, key_col, id_col, tampered or {}), ["doc_id", "leaf"], "merkle-rows")
    leaves = written(leaves.withColumnRenamed("leaf", "hash"), "merkle-leaves")
    trees = stored_levels(leaves, levels, "merkle-tree")
    tops = roots(trees).select(F.lit("").alias("key"), F.col("key").alias("source"), "hash")
    tops = written(numbered(tops, ["source"], "merkle-roots"), "merkle-tops")
    upper = stored_levels(tops, levels, "merkle-top")
    none = F.array().cast("array<struct<left: string, right: string>>")
    over = paths(upper, levels, roots(upper).select("key", none.alias("path"), F.col("hash").alias("root")), ("source",))
    over = over.select(F.col("source").alias("key"), "path", F.col("hash").alias("subroot"), "root")
    found = paths(trees, levels, over, ("doc_id", "changed"))
    proof = sha256(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
