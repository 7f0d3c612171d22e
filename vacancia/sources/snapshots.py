"""The postings history as a table of snapshots.

Each append writes its rows to a folder of its own and then a version: a small file that lists
the live parts of the table (a part is the rows of one folder and day, with their number). A
reader takes one version and reads its parts only, so it never sees half of a writing. A writer
puts its version under the next number; where another has taken that, it applies its change to
what the other has left and tries again, so both survive. Retention drops whole days by leaving
their parts out of the next version and rewrites the one day at the edge.

Beside its rows each writing keeps counts by day, source and role, and a Bloom filter of the URLs
of every file, in blocks of 32,768 bits. Both belong to the immutable writing, so appends,
retries and retention keep them right without correcting anything.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import joins, stats
from .history import STORED, retained, to_store

ROWS = T.StructType([*STORED.fields, T.StructField("batch", T.StringType()), T.StructField("write", T.StringType())])
COUNTS = "found_date date, batch string, source string, role string, n long, write string"
BLOCK, WORD = 32_768, 32
PROBES, BITS_A_URL = 4, 10
#: So many days are compacted at a time, each by tasks of its own.
DAYS_AT_ONCE = 8


class Conflict(RuntimeError):
    """Another writer has replaced parts that this one was about to replace."""


@dataclass(frozen=True)
class Part:
    """The rows of one writing and day (None: rows without an instant)."""

    write: str
    day: str | None
    rows: int
    files: int
    batches: tuple[str, ...]
    blocks: int

    @property
    def folder(self) -> str:
        return f"data/write={self.write}/found_date={self.day or '__HIVE_DEFAULT_PARTITION__'}"


def block_and_bits(url: Column, blocks: Column) -> tuple[Column, Column]:
    """Where a URL is noted in a Bloom filter of that many blocks."""
    h = F.xxhash64(url)
    return F.pmod(F.xxhash64(url, F.lit(1)), blocks).cast("int"), F.array(*(F.shiftrightunsigned(h, 15 * i).bitwiseAND(BLOCK - 1) for i in range(PROBES)))


def maps_of(blocks: int):
    """A pass over rows (f, block, h), h being xxhash64 of the URL: the bits of block_and_bits as
    one map of every block of a file that a task reads. It holds the maps of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, maps = None, np.zeros((blocks, BLOCK // 8), np.uint8)

        def done() -> pa.RecordBatch:
            some = np.flatnonzero(maps.any(axis=1))
            kept = pa.array([maps[i].tobytes() for i in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), file, np.int64)), pa.array(some.astype(np.int32)), kept], ["f", "block", "map"])

        for batch in batches:
            f, block, h = (batch.column(i).to_numpy() for i in range(3))
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(f[1:] != f[:-1]) + 1, len(f)])):
                if a == b:
                    continue
                if file is not None and f[a] != file:
                    yield done()
                    maps[:] = 0
                file = f[a]
                for i in range(PROBES):
                    bit = (h[a:b].view(np.uint64) >> np.uint64(15 * i)).astype(np.int64) & (BLOCK - 1)
                    np.bitwise_or.at(maps, (block[a:b], bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        if file is not None:
            yield done()

    return run


def words_of(bitmap: Column) -> Column:
    """The 4-byte words of a bitmap as numbers, so that single bits can be tested."""
    size = WORD // 8
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCK // WORD - 1)), lambda i: F.conv(F.hex(F.substring(bitmap, i * size + 1, F.lit(size))), 16, 10).cast("long"))


def has_bit(words: Column, bit: Column) -> Column:
    """Whether a bit is set: bytes are in order, bits inside a byte from the lowest."""
    place = WORD - 8 - F.floor(bit / 8) % (WORD // 8) * 8 + bit % 8
    word = F.get(words, F.floor(bit / WORD).cast("int"))
    return F.call_function("getbit", word, place.cast("int")) == 1


class Snapshots:
    """A history below `path`. Every method reads or makes one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._files = self._log.getFileSystem(self._conf)

    # Versions

    def versions(self) -> list[int]:
        if not self._files.exists(self._log):
            return []
        names = (x.getPath().getName() for x in self._files.listStatus(self._log))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _version_path(self, version: int):
        return self._jvm.org.apache.hadoop.fs.Path(self._log, f"{version:012d}.json")

    def parts(self, version: int | None = None) -> list[Part]:
        """The parts of a version, of the newest by default; none where nothing is stored yet."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return []
        stream = self._files.open(self._version_path(version))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Part(**{**x, "batches": tuple(x["batches"])}) for x in json.loads(text)]

    def _put(self, version: int, parts: list[Part]) -> bool:
        """Write a version under its number; False if that is taken."""
        text = json.dumps([asdict(p) for p in parts])
        own = self._jvm.org.apache.hadoop.fs.Path(self._log, f".{uuid.uuid4().hex}")
        out = self._files.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._version_path(version)
        try:
            if self._files.getScheme() == "file":  # a rename would replace another's version there
                os.link(own.toUri().getPath(), target.toUri().getPath())
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf).rename(own, target, options)
            return True
        except Exception:
            if not self._files.exists(target):
                raise
            return False
        finally:
            self._files.delete(own, False)

    def _commit(self, change: Callable[[list[Part]], list[Part]]) -> int:
        """Put change(the newest parts) as the next version; again if another was faster."""
        while True:
            newest = max(self.versions(), default=0)
            if self._put(newest + 1, change(self.parts(newest))):
                return newest + 1

    # Reading

    def _rows(self, parts: Iterable[Part]) -> DataFrame:
        folders = [f"{self.path}/{p.folder}" for p in parts]
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).option("basePath", f"{self.path}/data").parquet(*folders)

    def _live(self, since: str | None, version: int | None) -> list[Part]:
        return [p for p in self.parts(version) if since is None or p.day is not None and p.day >= since[:10]]

    def scan(self, since: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version; with `since` only parts of that day or later are listed."""
        return self._rows(self._live(since, version)).drop("batch", "write")

    def counts(self, version: int | None = None) -> DataFrame:
        """found_date, source, role, n of a version, from the counts kept with its writings."""
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], COUNTS).drop("batch", "write")
        stored = self.spark.read.schema(COUNTS).option("basePath", f"{self.path}/counts").parquet(*sorted({f"{self.path}/counts/write={p.write}" for p in parts}))
        live = self.spark.createDataFrame([(p.write, p.day) for p in parts], "w string, d string")
        one = (F.col("write") == F.col("w")) & F.col("found_date").cast("string").eqNullSafe(F.col("d"))
        # A row for each part of the version.
        return stored.join(F.broadcast(live), one, "left_semi").select("found_date", "source", "role", "n")

    def bundle(self, as_of: str, version: int | None = None) -> DataFrame:
        """The dashboard's counts (kind, name, n) without reading a row."""
        return stats.bundle_of_counts(self.counts(version), as_of)

    def newest(self, limit: int, offset: int = 0, version: int | None = None) -> DataFrame:
        """A page of the newest rows; older days than it needs are not read."""
        parts, wanted, days = self.parts(version), max(0, offset) + max(1, min(500, limit)), {}
        for p in parts:
            days[p.day or ""] = days.get(p.day or "", 0) + p.rows
        chosen = set()
        for day in sorted(days, reverse=True):
            if wanted <= 0:
                break
            chosen.add(day)
            wanted -= days[day]
        return stats.newest(self._rows(p for p in parts if (p.day or "") in chosen).drop("batch", "write"), limit, offset)

    def newest_before(self, found_at: str, row_id: int, limit: int, version: int | None = None) -> DataFrame:
        """The page after the row of that instant and id, newest first: a keyset, so deep pages
        cost no more than the first."""
        parts, wanted, chosen = self.parts(version), max(1, min(500, limit)), []
        day = found_at[:10]
        for d in sorted({p.day for p in parts if p.day and p.day <= day}, reverse=True):
            if wanted <= 0:
                break
            mine = [p for p in parts if p.day == d]
            chosen += mine
            wanted -= 0 if d == day else sum(p.rows for p in mine)
        if wanted > 0:
            chosen += [p for p in parts if p.day is None]
        at = F.lit(found_at).cast("timestamp_ntz")
        rows = self._rows(chosen).drop("batch", "write")
        return stats.newest(rows.where(F.col("found_at").isNull() | (F.col("found_at") < at) | (F.col("found_at") == at) & (F.col("row_id") < row_id)), limit)

    # URLs

    def files_with(self, urls: DataFrame, since: str | None = None, version: int | None = None) -> list[str]:
        """The files (of days from `since` on) whose Bloom filter may hold any of urls (url)."""
        parts = self._live(since, version)
        if not parts:
            return []
        kept = self.spark.read.option("basePath", f"{self.path}/blooms").parquet(*sorted({f"{self.path}/blooms/write={p.write}" for p in parts}))
        live = self.spark.createDataFrame([(p.write, p.day) for p in parts], "w string, d string")
        kept = kept.join(F.broadcast(live), (F.col("write") == F.col("w")) & F.col("day").eqNullSafe(F.col("d")), "left_semi")
        sizes = F.explode(F.array(*map(F.lit, sorted({p.blocks for p in parts}))))
        asked = urls.select(X.strip(F.col("url")).alias("url")).where("url <> ''").distinct().withColumn("u_blocks", sizes)
        block, bits = block_and_bits(F.col("url"), F.col("u_blocks"))
        asked = asked.select("u_blocks", block.alias("u_block"), *(bits[i].alias(f"bit{i}") for i in range(PROBES)))
        hit = (F.col("blocks") == F.col("u_blocks")) & (F.col("block") == F.col("u_block"))
        for i in range(PROBES):
            hit = hit & has_bit(F.col("words"), F.col(f"bit{i}"))
        found = kept.join(asked, hit, "left_semi").select("file").distinct()
        return sorted(r["file"] for r in found.collect())  # no more than the version has files

    def unseen(self, candidates: DataFrame, as_of: str, days: int) -> DataFrame:
        """Candidates whose URL was not stored in the last days. Only files of these days that
        may hold one of the URLs are opened; the result is exact."""
        first = (datetime.fromisoformat(as_of) - timedelta(days=max(1, days))).date().isoformat()
        files = self.files_with(candidates, first)
        stored = self.spark.read.schema(ROWS).option("basePath", f"{self.path}/data").parquet(*files) if files else self._rows([])
        return joins.unseen(candidates, stored, as_of, days)

    # Writing

    def _write(self, rows: DataFrame, files: int | None = None, grouped: bool = False) -> list[Part]:
        """Rows (as stored, with their batch) to a new folder, with counts and Bloom filters. Rows
        of a day are brought together, a large day in several files, so that small ones are few;
        those that come `grouped` by day, as from files of this table, are written as they come."""
        write = uuid.uuid4().hex
        (rows.coalesce(files) if files else rows if grouped else rows.hint("rebalance", "found_date")).write.partitionBy("found_date").parquet(f"{self.path}/data/write={write}")
        back = self.spark.read.schema(ROWS).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/write={write}").withColumn("file", F.col("_metadata.file_path"))
        role, source = F.coalesce(X.filled(F.col("search_role")), F.lit("Unknown")), F.coalesce(X.filled(F.col("source")), F.lit(""))
        counts = f"{self.path}/counts/write={write}"
        back.groupBy("found_date", "batch", source.alias("source"), role.alias("role"), "file").agg(F.count("*").alias("n")).coalesce(1).write.parquet(counts)
        by_file = self.spark.read.parquet(counts).groupBy(F.col("found_date").cast("string").alias("day"), "file")
        files_of = by_file.agg(F.sum("n").alias("n"), F.collect_set("batch").alias("batches"), F.xxhash64("file").alias("f"))
        found = files_of.collect()  # a row for each new file
        if not found:
            return []
        blocks = 1
        while blocks * BLOCK < BITS_A_URL * max(r["n"] for r in found):
            blocks *= 2
        noted = back.select(F.xxhash64("file").alias("f"), block_and_bits(F.col("url"), F.lit(blocks))[0].alias("block"), F.xxhash64("url").alias("h"))
        maps = noted.mapInArrow(maps_of(blocks), "f long, block int, map binary").groupBy("f", "block").agg(F.bitmap_or_agg("map").alias("map"))
        named = maps.join(F.broadcast(files_of.select("f", "file", "day")), "f")  # files of one hash would share their maps
        named.select("file", "day", F.lit(blocks).alias("blocks"), "block", words_of(F.col("map")).alias("words")).write.parquet(f"{self.path}/blooms/write={write}")
        out: dict[str | None, Part] = {}
        for r in found:
            p = out.get(r["day"], Part(write, r["day"], 0, 0, (), blocks))
            out[r["day"]] = replace(p, rows=p.rows + r["n"], files=p.files + 1, batches=tuple(sorted({*p.batches, *r["batches"]})))
        return list(out.values())

    def append(self, df: DataFrame, found_at: str | None = None, batch: str | None = None, grouped: bool = False) -> int:
        """Store rows; returns how many. A batch that is stored again takes the place of its
        first writing."""
        name = batch or uuid.uuid4().hex
        added = self._write(to_store(df, found_at).withColumn("batch", F.lit(name)).select(*(c for c in ROWS.names if c in {*df.columns, "found_at", "found_date", "batch"})), grouped=grouped)
        mixed: dict[Part, list[Part]] = {}

        def change(parts: list[Part]) -> list[Part]:
            left = []
            for p in parts:
                if name not in p.batches:
                    left.append(p)
                elif len(p.batches) > 1:  # compacted together with others
                    if p not in mixed:
                        mixed[p] = self._write(self._rows([p]).where(F.col("batch") != name).drop("write"), grouped=True)
                    left += mixed[p]
            return left + added

        self._commit(change)
        return sum(p.rows for p in added)

    def _replace(self, old: list[Part], new: list[Part]) -> None:
        def change(parts: list[Part]) -> list[Part]:
            if not set(old) <= set(parts):
                raise Conflict("parts to be replaced are gone")
            return [p for p in parts if p not in old] + new

        self._commit(change)

    def expire(self, as_of: str, days: int = 30) -> int:
        """Drop rows older than days, and those without an instant; returns how many. Whole days
        go without being read; the day at the edge is rewritten."""
        edge = (datetime.fromisoformat(as_of) - timedelta(days=max(1, days))).date().isoformat()
        parts = self.parts()
        old = [p for p in parts if p.day is None or p.day < edge]
        cut = [p for p in parts if p.day == edge]
        new = self._write(retained(self._rows(cut), as_of, days).drop("write")) if cut else []
        if sum(p.rows for p in new) == sum(p.rows for p in cut):
            cut, new = [], []
        if old or cut:
            self._replace(old + cut, new)
        return sum(p.rows for p in old + cut) - sum(p.rows for p in new)

    def compact(self, rows_a_file: int = 5_000_000, least: int = 2) -> int:
        """Rewrite the days of at least `least` files more than their rows need, each with fewer
        and larger files; returns the number of days."""
        days: dict[str | None, list[Part]] = {}
        for p in self.parts():
            days.setdefault(p.day, []).append(p)
        chosen = {d: ps for d, ps in days.items() if sum(p.files for p in ps) - -(-sum(p.rows for p in ps) // rows_a_file) >= least}

        def write(parts: list[Part]) -> list[Part]:
            return self._write(self._rows(parts).drop("write"), -(-sum(p.rows for p in parts) // rows_a_file))

        with ThreadPoolExecutor(DAYS_AT_ONCE) as pool:
            for parts, new in zip(chosen.values(), pool.map(write, chosen.values())):
                self._replace(parts, new)
        return len(chosen)

    def clear(self) -> int:
        """Empty the table; returns how many rows it had. Older versions can still be read."""
        gone: list[Part] = []

        def change(parts: list[Part]) -> list[Part]:
            gone[:] = parts
            return []

        self._commit(change)
        return sum(p.rows for p in gone)

    def vacuum(self, keep: int = 10) -> int:
        """Delete all but the newest versions, and the writings that only they read; returns the
        number of writings. Folders of writers that have not put their version yet stay."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        needed = {p.write for v in kept for p in self.parts(v)}
        gone = {p.write for v in old for p in self.parts(v)} - needed
        for version in old:
            self._files.delete(self._version_path(version), False)
        for write in gone:
            for kind in ("data", "counts", "blooms"):
                self._files.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/write={write}"), True)
        return len(gone)
