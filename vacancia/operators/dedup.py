"""Order-dependent merges of duplicate rows. Every operator takes an order column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as X
from .filters import first_per

FILL = ("posted_time", "job_description", "freshness", "salary", "employment_type")


def richness() -> Column:
    weights = {"posted_time": 100, "job_description": 10, "freshness": 1, "salary": 1, "employment_type": 1}
    return sum((F.when(~X.is_blank(F.col(c)), w).otherwise(0) for c, w in weights.items()), F.lit(0))


def packed(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The values from each offset to the next: strings, or nulls, as one string, others as a list."""
    if pa.types.is_string(values.type):
        clear = pc.replace_substring(pc.replace_substring(values, "\x02", "\x02b"), "\x01", "\x02a").fill_null("\x02")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), clear), "\x01")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def unpacked(df: DataFrame, texts: list[str], others: list[str], beside: list[str]) -> DataFrame:
    """The rows of packed columns, with the columns beside them."""
    lists = df.withColumns({n: F.split(n, "\x01") for n in texts})
    rows = lists.select(*beside, F.inline(F.arrays_zip(*texts, *others)))
    plain = lambda n: F.replace(F.replace(F.col(n), F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))
    return rows.withColumns({n: F.when(F.col(n) != "\x02", plain(n)) for n in texts})


def _thinned(picks: dict[str, tuple[bool, str]], order: str, sent: list[str], most: int = 1 << 18, most_bytes: int = 64 << 20):
    """A map over rows that lets go of what cannot matter to a merge: of the rows of a key in a slice
    of the task's rows, those stay that a pick (whether it has scores, its field) may take, which
    `_may` has a bit for, and the first of each location; columns for which a row does not stay are
    null. `_n` of the key's first row counts the rows let go. The rows of a slice and a bucket `_b` are
    sent as one, column by column, which takes much less room in a shuffle."""

    def first(runs: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(runs, prepend=-1))

    def thin(slice_: pa.Table) -> pa.Table:
        t, c, place = (slice_.column(n).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for n in ("_t", "_c", "_where"))
        key = np.unique(t * (c.max() + 1) + c, return_inverse=True)[1]
        ahead = np.lexsort((slice_.column(order).to_numpy(), key))
        runs = key[ahead]
        begin = first(runs)
        if len(begin) == len(runs):
            return slice_
        may = np.zeros(len(runs), np.int64)
        for i, (name, (scored, _)) in enumerate(picks.items()):
            score = slice_.column(name).combine_chunks()
            ok = score.is_valid().to_numpy(zero_copy_only=False)[ahead]
            if scored:
                score = score.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()[ahead]
                ok &= score == np.maximum.reduceat(score, begin)[runs]
            at = np.flatnonzero(ok)
            may[at[first(runs[at])]] |= 1 << i
        kept = may != 0
        kept[np.unique(runs * (place.max() + 1) + place[ahead], return_index=True)[1]] = True
        times = np.ones(len(runs), np.int64)
        times[begin] += np.bincount(runs[~kept], minlength=len(begin))
        alone = np.diff(begin, append=len(runs))[runs] == 1
        may[alone] = -1
        out, may = slice_.take(pa.array(ahead[kept])), may[kept]
        made = {"_n": pa.array(times[kept]), "_may": pa.array(may)}
        bits = {n: sum(1 << i for i, (_, field) in enumerate(picks.values()) if field in ("*", n)) for n in out.column_names if n not in {"_b", "_t", "_c", "_where", "location", order, *picks, *made}}
        for n, bit in bits.items():
            made[n] = pc.if_else(pa.array(may & bit != 0), out.column(n), pa.scalar(None, out.schema.field(n).type))
        return pa.table([made.get(n, out.column(n)) for n in out.column_names], names=out.column_names)

    def together(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.argsort(rows.column("_b").to_numpy(), kind="stable")))
        bucket = rows.column("_b").to_numpy()
        begin = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        offsets = np.append(begin, len(bucket))
        columns = [packed(rows.column(n).combine_chunks(), offsets) for n in sent]
        yield from pa.table([pa.array(bucket[begin]), *columns], names=["_b", *sent]).to_batches(max_chunksize=100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most or size >= most_bytes:
                yield from together(thin(pa.Table.from_batches(held)))
                held, rows, size = [], 0, 0
        if rows:
            yield from together(thin(pa.Table.from_batches(held)))

    return run


def _merge(df: DataFrame, picks: dict[str, tuple[Column | None, Column, str]], final: dict[str, Column], order: str, keyed: bool = False) -> DataFrame:
    """One row per title and company: that of the pick `_row`. A pick is (score, condition, field):
    of the row of the greatest score (None: all alike), and of these the first, among those that
    meet the condition, that field or the whole row (`*`); score and condition are made of that
    field alone, or of the whole row. final are columns made of the picks.
    keyed: title and company are keys already, as X.key makes them.

    Rows are shuffled once, by the bucket of title and company, and all else is done where they then lie. Each
    task first lets go of rows that cannot matter, so that a hot title sends a few rows of each
    slice and its locations. Rows with a blank key are not shuffled."""
    t, c = (F.col(n) if keyed else X.key(F.col(n)) for n in ("title", "company"))
    has, place = F.coalesce((t != "") & (c != ""), F.lit(False)), X.strip(X.text(F.col("location")))
    sent = [n for n in df.columns if not keyed or n not in ("title", "company")]
    scores = [F.when(test, F.lit(0) if score is None else score).alias(n) for n, (score, test, _) in picks.items()]
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = {"_b": F.pmod(F.xxhash64(t, c), F.lit(buckets)).cast("int"), "_t": t, "_c": c, "_n": F.lit(1).cast("long"), "_may": F.lit(-1).cast("long")}
    rows = df.where(has).select(*(v.alias(n) for n, v in made.items()), *sent, place.alias("_where"), *scores)
    types = {n: rows.schema[n].dataType for n in ("_t", "_c", "_n", "_may", *sent)}
    texts = [n for n, kind in types.items() if kind == StringType()]
    thin = _thinned({n: (score is not None, field) for n, (score, _, field) in picks.items()}, order, [*types])
    slices = rows.mapInArrow(thin, StructType([StructField("_b", IntegerType()), *(StructField(n, kind if n in texts else ArrayType(kind)) for n, kind in types.items())]))
    dealt = unpacked(slices.repartition("_b"), texts, [n for n in types if n not in texts], ["_b"])

    def best(values: dict[str, Column], ranks: dict[str, Column]) -> list[Column]:
        made = []
        for n, (score, *_) in picks.items():
            by, of = (F.min_by, F.min) if score is None else (F.max_by, F.max)
            made += [by(values[n], ranks[n]).alias(n), of(ranks[n]).alias(f"{n}_rank")]
        return made

    values = {n: F.struct(*sent) if field == "*" else F.col(field) for n, (_, _, field) in picks.items()}
    may = {n: F.col("_may").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i, n in enumerate(picks)}
    ranks = {n: F.when(may[n] & test, F.col(order) if score is None else F.struct(score, F.bitwise_not(F.col(order)))) for n, (score, test, _) in picks.items()}
    parts = dealt.groupBy("_b", "_t", "_c", place.alias("_where")).agg(*best(values, ranks), F.sum("_n").alias("_n"), F.min(order).alias("_at"))
    places = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_where"))), lambda x: x["_where"])
    one = parts.groupBy("_b", "_t", "_c").agg(*best({n: F.col(n) for n in picks}, {n: F.col(f"{n}_rank") for n in picks}), F.sum("_n").alias("_n"), places.alias("_places"))
    single = F.col("_n") == 1
    columns = {n: F.when(single, F.col(f"_row.{n}")).otherwise(v) for n, v in (final | {"location": X.merged_locations(F.col("_places"))}).items()}
    columns |= {"title": F.col("_t"), "company": F.col("_c")} if keyed else {}
    merged = one.select(*(columns.get(n, F.col(f"_row.{n}") if n in sent else F.lit(None)).alias(n) for n in df.columns), F.col("_n").alias("merged_rows"))
    return merged.unionByName(df.where(~has).withColumn("merged_rows", F.lit(1).cast("long")))


def cross_source(df: DataFrame, order: str = "row_id", keyed: bool = False) -> DataFrame:
    """One row per title and company: the richest (ties: the first), its blank fields filled
    from the first row that has them, locations merged in order. Rows with a blank key pass.
    merged_rows counts the rows behind each; single rows stay as they are. keyed: title and
    company are keys already, as X.key makes them."""
    picks = {"_row": (richness(), F.lit(True), "*")} | {f"_f_{c}": (None, ~X.is_blank(F.col(c)), c) for c in FILL}
    final = {c: F.coalesce(X.filled(F.col(f"_row.{c}")), F.col(f"_f_{c}"), F.col(f"_row.{c}")) for c in FILL}
    return _merge(df, picks, final, order, keyed)


def board_rows(df: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per title and company: the first, with the longest description (ties: the
    first) and locations merged in order."""
    picks = {"_row": (None, F.lit(True), "*"), "_d": (F.char_length(X.text(F.col("job_description"))), F.lit(True), "job_description")}
    longer = F.char_length(X.text(F.col("_d"))) > F.char_length(X.text(F.col("_row.job_description")))
    return _merge(df, picks, {"job_description": F.when(longer, F.col("_d")).otherwise(F.col("_row.job_description"))}, order)


def in_run(df: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per title and company: the first, with locations merged into it."""
    return _merge(df, {"_row": (None, F.lit(True), "*")}, {}, order)


def first_by_url(df: DataFrame, order: str = "row_id") -> DataFrame:
    return first_per(df, ["url"], [order])


def passes(df: DataFrame, order: str = "pass_no") -> DataFrame:
    """Merge several parsers' rows of a URL: the first wins, its blank company, location and
    job_id are filled in order, easy_apply sticks."""
    fill = [c for c in ("company", "location", "job_id") if c in df.columns]
    first = F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")
    filled = [F.min_by(c, F.when(~X.is_blank(F.col(c)), F.col(order))).alias(f"_f_{c}") for c in fill]
    easy = F.bool_or(F.col("apply_type") == "easy_apply").alias("_easy")
    groups = df.groupBy(F.col("url").alias("_url")).agg(first, *filled, easy)
    values = {c: F.coalesce(F.col(f"_f_{c}"), F.lit("")) for c in fill} | {"apply_type": F.when(F.col("_easy"), "easy_apply").otherwise(F.col("_row.apply_type"))}
    return groups.select(*(values.get(c, F.col(f"_row.{c}")).alias(c) for c in df.columns))


def accepted(gap: int):
    """A fold over rows (url, us, id) sorted by url and instant that keeps the id of each row
    whose URL has no accepted row younger than gap. Its state is one accepted instant."""

    def jumps(runs: np.ndarray, us: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which rows are accepted: from `first` of each run, on to the first row gap later."""
        keep = np.zeros(len(us), bool)
        low = us.min()
        span = int(us.max() - low) + gap + 1
        step = max(1, (1 << 62) // span)  # so many runs fit into one integer key
        for at in range(0, int(runs[-1]) + 1, step):
            a, b = np.searchsorted(runs, [at, at + step])
            key = (runs[a:b] - at) * span + (us[a:b] - low)
            now = first[at : at + step]
            now = now[now >= 0] - a
            while len(now):
                keep[a + now] = True
                then = np.searchsorted(key, key[now] + gap)
                ok = then < len(key)
                ok[ok] = runs[a + then[ok]] == runs[a + now[ok]]
                now = then[ok]
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_url, last_us = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            url, us = batch.column(0), batch.column(1).to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(url.slice(1), url.slice(0, len(url) - 1)).to_numpy(zero_copy_only=False)
            runs, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            first = begin.copy()
            if url[0].as_py() == last_url:  # the run goes on from the batch before
                end = begin[1] if len(begin) > 1 else len(us)
                at = int(np.searchsorted(us[:end], last_us + gap))
                first[0] = at if at < end else -1
            keep = jumps(runs, us, first)
            here = np.flatnonzero(keep & (runs == runs[-1]))
            if len(here) or runs[-1] > 0 or url[0].as_py() != last_url:
                last_url, last_us = url[len(url) - 1].as_py(), int(us[here[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(keep))], ["_ok"])

    return run


def rolling(df: DataFrame, days: int, order: str = "row_id", at: str = "found_at") -> DataFrame:
    """Accepted rows: no accepted row of the URL is younger than `days` days. An accepted
    row starts a new window, so this is a fold over each URL's rows in time.

    Rows are first thinned to the earliest of each URL and instant, before the shuffle. A
    URL's instants then stream through the fold in sorted order; none are collected, so a
    URL of any number of rows needs no more memory than a batch."""
    gap = max(1, days) * 86_400_000_000
    rows = df.where(~X.is_blank(F.col("url"))).withColumns({"_url": X.strip(F.col("url")), "_us": F.unix_micros(F.col(at).cast("timestamp"))})
    first = rows.where("_us is not null").groupBy("_url", "_us").agg(F.min(order).cast("long").alias("_id"))
    kept = first.repartition("_url").sortWithinPartitions("_url", "_us").mapInArrow(accepted(gap), "_ok long")
    return df.join(kept, F.col(order) == F.col("_ok"), "left_semi")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)
