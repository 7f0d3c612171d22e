"""Operator 9: near-duplicates by SuperMinHash, banding, verification and components.

A document's set holds its distinct five-word shingles. SuperMinHash gives each element a
random permutation of the slots; an element's rank in a slot is its position in that
permutation plus a random fraction, and a slot keeps the least rank. Since ranks come in
levels, a document's work stops once every slot has a rank of an earlier level.

Documents of equal sets form a class. Bands of the signature put classes into buckets, and
every two classes that share a bucket are decided, exactly and on full sets, without listing
the pairs of a bucket:

* Each class is verified against the class of its buckets that meets most others there, its
  hub. A bucket whose classes then form one component is done.
* In a bucket of several components all classes are compared with one hub h. Let D(x) be the
  symmetric difference of x and h. Classes x and y are linked if the symmetric difference of
  D(x) and D(y) has at most k (|x| + |y|) elements, k = (100 - percent) / (100 + percent). If x
  is not linked to h, it follows that D(x) and D(y) share more than ((1 - k) a + (1 + k) b) / 2
  elements, where y has a elements that h lacks and lacks b of h. So with elements in order
  of their frequency, rare ones first, x and y share an element among the first of D(x) and
  D(y) that leave less than this number over (a prefix filter): classes of different edits do
  not meet at all.
* Of the classes that share such an element, those of one component are not compared any
  more. Each is first verified against a class drawn from them (`draws` times), which unites
  groups that hold together apart from h; then what is still open is verified by pairs. In
  either case a pair is left out before if the sizes of the differences, or bit maps of them,
  prove that it is not linked: every bit that only one has is an element that only one has.

Components grow by large and small stars, as joins; nothing whole passes through the driver
or one task, and no bucket, partner or candidate is dropped.

Defined cases: null and empty texts, and texts without words, have an empty set and stand
alone; very long texts are worked through whole; equal rows share a component, as do rows of
one id that are linked; rows of one id whose texts are unlike may have several components;
a null id stands alone with a null component and is kept; an empty table gives no row;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import SPACED, document_shingles, mix, words
from .shared import slices, text_buffer, written

BANDS, ROWS = 36, 5
SLOTS = BANDS * ROWS
SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
FRACTION = 24
#: Bytes of text that are signed at a time; their permutations take up to 40 times as much.
SLICE = 2 << 20
#: 64-bit words in the bit map of a difference.
MAP = 16


def signatures(sets: np.ndarray, pointers: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of many sets laid end to end: level in the upper 8 bits, fraction below."""
    n = np.diff(pointers)
    table = np.full(len(n) * slots, 0xFFFFFFFF, np.uint32)
    doc, item = np.repeat(np.arange(len(n)), n), sets
    perm = first = second = None
    for level in range(slots):
        if not len(item):
            break
        x = mix(item + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
        pick = level + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = first = pick
        elif level == 1:
            slot, second = np.where(pick == first, 0, pick), pick
        else:
            rows = np.arange(len(item))
            if perm is None:  # replay the first two exchanges
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(item), 1))
                for j, k in enumerate((first, second)):
                    perm[rows, j], perm[rows, k] = perm[rows, k], perm[rows, j].copy()
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, level]
            perm[rows, level] = slot
        value = np.uint32(level << FRACTION) | (x >> np.uint64(64 - FRACTION)).astype(np.uint32)
        np.minimum.at(table, doc * slots + slot, value)
        # Slots of a later rank or none can still improve; other documents are done.
        open_docs = (table.reshape(-1, slots) >= np.uint32(level + 1) << np.uint32(FRACTION)).any(1)
        live = open_docs[doc]
        if not live.all():
            doc, item = doc[live], item[live]
            first, second = first[live], None if second is None else second[live]
            perm = None if perm is None else perm[live]
    return table.reshape(-1, slots)


def band_keys(table: np.ndarray) -> np.ndarray:
    parts = table.reshape(len(table), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(table), BANDS)).copy()
    for j in range(ROWS):
        out = mix(out ^ parts[:, :, j])
    return out.view(np.int64)


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of the texts, pointers to them and a hash of each set, 128 bits in two."""
    _, _, hashes, pointers = words(*text_buffer(column), SPACED)
    sets, at = document_shingles(hashes, pointers, 5)
    n = np.diff(at).astype(np.uint64)
    out = []
    for seed in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(seed)))])
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    return sets, at, *out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets, at, set_a, set_b = sets_of(batch.column(2))
            n = np.diff(at)
            some = n > 0
            table = signatures(sets, np.concatenate([[0], np.cumsum(n[some])]), SLOTS)
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(table).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(set_a, mask=~some), pa.array(set_b, mask=~some), bands], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(sign, SIGNED)


def packed_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """node and its sorted set for the nodes of wanted (node, s_id, s_hash). Up to
    broadcast_rows wanted rows, of three numbers, are broadcast; more are joined by a shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets, at, *_ = sets_of(batch.column(1))
            raw = sets.astype("<u8").tobytes()
            packed = [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("t_id"), F.xxhash64(text).alias("t_hash"), text.alias("text"))
    texts = own.join(few, (F.col("t_id") == F.col("s_id")) & (F.col("t_hash") == F.col("s_hash"))).select("node", "text")
    return texts.mapInArrow(make, "node long, packed binary").dropDuplicates(["node"])


COMPARED = "a long, b long, linked boolean, n_a int, n_b int, added array<long>, lost array<long>, map array<long>"


def compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """Of each pair (a, b): whether the sets are linked, their sizes, and, if asked for, the
    elements of a that b lacks, those of b that a lacks, and a bit map of both."""

    def bit_map(elements: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * MAP, bool)
        bits[mix(elements.view(np.uint64)) % np.uint64(64 * MAP)] = True
        return np.packbits(bits).view("<i8")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, lists = [], ([], []), ([], [], [])
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), "<i8") for z in (x, y))
                if differences:
                    added, lost = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                    same, bits = len(x) - len(added), bit_map(np.concatenate([added, lost]))
                else:
                    both = np.concatenate([x, y])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    added = lost = bits = None
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
                for out, value in ((sizes[0], len(x)), (sizes[1], len(y)), (lists[0], added), (lists[1], lost), (lists[2], bits)):
                    out.append(value)
            columns = [pa.array(linked, pa.bool_()), *(pa.array(c, pa.int32()) for c in sizes), *(pa.array(c, pa.list_(pa.int64())) for c in lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["a", "b", "linked", "n_a", "n_b", "added", "lost", "map"])

    left = sets.withColumnsRenamed({"node": "a", "packed": "packed_a"})
    right = sets.withColumnsRenamed({"node": "b", "packed": "packed_b"})
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "packed_a", "packed_b").mapInArrow(test, COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component) for the nodes of edges (a, b), by large and
    small stars in turn until the edges stay as they are."""
    def kept(e: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation("stars")
        table = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "edges")
        return table, seen.get

    edges, before = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while before["n"]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        edges, now = kept(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def with_labels(df: DataFrame, labels: DataFrame, node: str = "node", comp: str = "comp") -> DataFrame:
    """df with the component of its node; a node without one is its own."""
    own = labels.select(F.col("node").alias("_l_node"), F.col("comp").alias("_l_comp"))
    return df.join(own, F.col(node) == F.col("_l_node"), "left").withColumn(comp, F.coalesce("_l_comp", node)).drop("_l_node", "_l_comp")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the components of linked nodes (a, b) have become one."""
    ends = with_labels(with_labels(links, labels, "a", "c_a"), labels, "b", "c_b")
    moved = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    new = with_labels(labels.select("node", F.col("comp").alias("old")), moved, "old").select("node", "comp")
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return written(new.unionAll(fresh), "labels")


def left_open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups (key, node, n and other columns), with comp, whose key has several components."""
    places = with_labels(groups, labels)
    mixed = places.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("key")
    return places.join(mixed, "key")


def alike(x: str, y: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def shared_differences(found: DataFrame, percent: int) -> DataFrame:
    """key (of hub and element), node, n, na, nl, map, as_x, as_y: the elements of each
    compared node's difference to its hub by which a node that is not linked to the hub (x)
    and a node linked to that one (y) meet."""
    size = F.col("na") + F.col("nl")
    sized = found.select(F.col("a").alias("node"), F.col("b").alias("hub"), (~F.col("linked")).alias("unlinked"), F.col("n_a").alias("n"), "n_b", F.size("added").alias("na"), F.size("lost").alias("nl"), "map", F.concat("added", "lost").alias("all"))
    each = sized.select("*", F.explode("all").alias("e")).drop("all")
    counts = each.groupBy("hub", "e").agg(F.count("*").alias("many"), F.bool_or("unlinked").alias("any_unlinked")).where("many > 1 and any_unlinked").select(F.col("hub").alias("c_hub"), F.col("e").alias("c_e"), "many")
    met = each.join(counts, (F.col("hub") == F.col("c_hub")) & (F.col("e") == F.col("c_e")))
    # Elements that no other has come first in the order of frequency, and do not count here.
    own = Window.partitionBy("node", "hub")
    met = met.withColumns({"at": F.row_number().over(own.orderBy("many", "e")), "met": F.count("*").over(own)})
    least = F.floor((percent * F.col("na") + 100 * F.col("nl")) / (100 + percent)) + 1
    least_unlinked = F.greatest(F.lit(1), F.ceil(((100 + percent) * size - (100 - percent) * (F.col("n") + F.col("n_b"))) / (2 * (100 + percent))))
    within = F.col("at") + size - F.col("met") <= size + 1 - least
    within_unlinked = F.col("unlinked") & (F.col("at") + size - F.col("met") <= size + 1 - least_unlinked)
    return met.where(within | within_unlinked).select(F.xxhash64("hub", "e").alias("key"), "node", "n", "na", "nl", "map", within.alias("as_y"), within_unlinked.alias("as_x"))


NODE = ("node", "n", "na", "nl", "map", "comp")


def candidates(groups: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that meet and may be linked: nodes of
    groups in the role of x, those of others (key, y_node, ...) in that of y."""
    x = groups.where("as_x").select(F.col("key").alias("x_key"), *(F.col(c).alias(f"x_{c}") for c in NODE))
    most = (100 - percent) * (F.col("x_n") + F.col("y_n"))
    sizes = F.abs(F.col("x_na") - F.col("y_na")) + F.abs(F.col("x_nl") - F.col("y_nl"))
    bits = sum(F.bit_count(F.get("x_map", F.lit(i)).bitwiseXOR(F.get("y_map", F.lit(i)))) for i in range(MAP))
    meet = (F.col("x_key") == F.col("key")) & (F.col("x_comp") != F.col("y_comp")) & alike("x_n", "y_n", percent) & ((100 + percent) * sizes <= most) & ((100 + percent) * bits <= most)
    return x.join(others, meet).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, draws: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, component_hash for every row of docs.
    component_id and component_hash are those of the component's least row by (doc_id, hash
    of the text), so they tell components apart even where ids repeat."""
    rows = written(signed(docs, id_col, text_col), "signatures")
    classes = rows.where("set_a is not null and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("least.doc_id").alias("s_id"), F.col("least.text_hash").alias("s_hash"), "n", "bands"), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    buckets = written(banded.join(shared, "key"), "buckets")

    # How many classes a class meets in its buckets, repeats included; a text that others
    # were copied from meets most.
    members = written(buckets.groupBy("node").agg(F.sum("many").alias("meets")).join(classes.select("node", "s_id", "s_hash"), "node"), "members")
    sets = written(packed_sets(docs, id_col, text_col, members.select("node", "s_id", "s_hash")), "sets")
    placed = buckets.select("key", "node", "n").join(members.select("node", "meets"), "node").select("key", "node", "n", F.struct("meets", "node").alias("place"))
    tops = placed.groupBy("key").agg(F.max(F.struct("place", "n")).alias("top"))
    first = placed.join(tops, "key").where((F.col("top.place") > F.col("place")) & alike("n", "top.n", percent)).groupBy("node", "place").agg(F.max("top.place").alias("hub"))
    first = written(first, "hubs")
    links = compared(first.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), sets, percent).where("linked")
    labels = components(links.select("a", "b"))

    # Where a bucket holds several components, its classes are compared with one hub.
    best = placed.join(first.select("node", "hub"), "node", "left").select("key", "node", F.greatest("place", "hub").alias("best"))
    groups = written(left_open(best, labels), "groups")
    hubs = groups.groupBy("key").agg(F.max("best").alias("top"))
    pairs = groups.join(hubs, "key").select(F.col("node").alias("a"), F.col("top.node").alias("b")).where("a <> b").distinct()
    found = written(compared(pairs, sets, percent, True), "differences")
    labels = merged(labels, found.where("linked"))
    met = written(shared_differences(found, percent), "met")
    for draw in range(draws):
        groups = left_open(met, labels)
        some = F.struct(F.xxhash64("node", F.lit(draw)).alias("by"), *NODE)
        drawn = groups.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("as_x") & F.col("as_y"), some)), F.max(F.when(F.col("as_y"), some))).alias("y")).select("key", *(F.col(f"y.{c}").alias(f"y_{c}") for c in NODE))
        labels = merged(labels, compared(candidates(groups, drawn, percent), sets, percent).where("linked"))
    groups = left_open(met, labels)
    every = groups.where("as_y").select("key", *(F.col(c).alias(f"y_{c}") for c in NODE))
    labels = merged(labels, compared(candidates(groups, every, percent), sets, percent).where("linked"))

    least = with_labels(classes.select("node", "set_a", "set_b", "s_id", "s_hash"), labels)
    lowest = least.groupBy("comp").agg(F.min(F.struct("s_id", "s_hash")).alias("least"))
    least = least.join(lowest, "comp").select(F.col("set_a").alias("l_a"), F.col("set_b").alias("l_b"), "least")
    out = rows.join(least, F.col("doc_id").isNotNull() & (F.col("set_a") == F.col("l_a")) & (F.col("set_b") == F.col("l_b")), "left")
    component = F.coalesce("least.s_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash", F.coalesce("least.s_hash", "text_hash").alias("component_hash"))
