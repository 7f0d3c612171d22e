"""Operator 10: secret scan with multipart credential linking.

Base kinds (`assign`, `access`, `hex`) are reported wherever their patterns match. Weak
candidates mean little alone: `key` (a long token of mixed letters and digits), `ident`
(an account or client id) and `endpoint` (a URL). An interval join inside each document
reports them only where complementary parts start within `scope` code points: a key near
an identifier (access or ident), an identifier near a secret (assign, hex or key), an
endpoint near both. The join compares each candidate with the first and last start of
either class in its own and the two neighbouring buckets of `scope` code points, which
decides existence exactly without listing pairs.

Defined cases: null and empty texts have no spans; very long texts are scanned whole; rows of one id and text share one
result and each keep their row; an empty table gives no row; other columns of the input
are not read by `find_secrets` and are kept by `redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

# The patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

KEY = re.compile(r"[A-Za-z0-9+/=_-]{32,}", re.A)
IDENT = re.compile(r"(?:account|client|user|key|access)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{6,}", re.I | re.A)
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+")

KINDS = ("assign", "access", "hex", "key", "ident", "endpoint")
PART = "array<struct<start:int,kind:int,end:int>>"
FOUND = f"doc_id long, text_hash long, parts {PART}"


def text_parts(text: str) -> list[dict[str, int]]:
    """Base spans and weak candidates of one text; starts and ends in code points."""
    base: list[tuple[int, int, int]] = []
    named = ":" in text or "=" in text
    if named:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    weak = [(m.start(), 3, m.end()) for m in KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    if named:
        weak += [(m.start(), 4, m.end()) for m in IDENT.finditer(text)]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    apart, i, high = [], 0, -1
    for x in sorted(weak):  # drop those that overlap a base span
        while i < len(base) and base[i][0] < x[2]:
            high = max(high, base[i][2])
            i += 1
        if high <= x[0]:
            apart.append(x)
    return [{"start": a, "kind": k, "end": b} for a, k, b in sorted(base + apart)]


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash and its parts in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            parts = [text_parts(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, kind)], ["doc_id", "text_hash", "parts"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(scan, FOUND)


def link_parts(found: DataFrame, scope: int = 300) -> DataFrame:
    """The weak candidates of found that have complementary parts in scope, by document."""
    own = ["doc_id", "text_hash"]
    parts = found.where(F.exists("parts", lambda x: x["kind"] >= 3)).select(*own, F.explode("parts").alias("part")).select(*own, "part.*").distinct().withColumn("bucket", F.floor(F.col("start") / scope))
    ident, secret = F.col("kind").isin(1, 4), F.col("kind").isin(0, 2, 3)
    near = parts.groupBy(*own, "bucket").agg(*(f(F.when(c, F.col("start"))).alias(n) for c, k in ((ident, "ident"), (secret, "secret")) for f, n in ((F.min, f"first_{k}"), (F.max, f"last_{k}"))))
    near = near.withColumnsRenamed({c: f"near_{c}" for c in (*own, "bucket")})
    weak = parts.where("kind >= 3").withColumn("at", F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))))

    def within(k: str):
        low, high = F.col("start") - scope, F.col("start") + scope
        return F.coalesce(F.max((F.col(f"first_{k}").between(low, high)) | (F.col(f"last_{k}").between(low, high))), F.lit(False))

    joined = weak.join(near, F.col("doc_id").eqNullSafe(F.col("near_doc_id")) & (F.col("text_hash") == F.col("near_text_hash")) & (F.col("at") == F.col("near_bucket")))
    flags = joined.groupBy(*own, "start", "kind", "end").agg(within("ident").alias("ident"), within("secret").alias("secret"))
    linked = flags.where(F.when(F.col("kind") == 3, F.col("ident")).when(F.col("kind") == 4, F.col("secret")).otherwise(F.col("ident") & F.col("secret")))
    return linked.groupBy(*own).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of start, kind, end in order) of every row."""
    found = written(find_parts(docs, id_col, text_col), "secret-parts")
    linked = link_parts(found, scope).withColumnsRenamed({"doc_id": "l_doc_id", "text_hash": "l_text_hash"})
    base = F.filter("parts", lambda x: x["kind"] < 3)
    joined = found.join(linked, F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("text_hash") == F.col("l_text_hash")), "left")
    spans = F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(PART))))
    return joined.select("doc_id", "text_hash", F.array_sort(base).alias("base"), spans.alias("spans"))


def spans_text(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", scope: int = 300) -> DataFrame:
    """docs with every reported span replaced by [kind]; overlapping spans count as one."""
    secrets = find_secrets(docs, id_col, text_col, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("s_doc_id"), F.col("text_hash").alias("s_text_hash"), F.col("spans").alias("s_spans")).distinct()

    @F.pandas_udf("string")
    def cover(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, found):
            out, at, high = [], 0, -1
            for x in found:
                if x["start"] >= high:
                    out += [t[at : x["start"]], f"[{KINDS[x['kind']]}]"]
                high = at = max(high, x["end"])
            return "".join(out) + t[at:]

        return pd.Series([t if s is None else one(t, s) for t, s in zip(text, spans)], dtype=object)

    # The row travels as one struct, so its columns can have any names.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("s_row"))
    text = F.col(f"s_row.`{text_col}`").cast("string")
    joined = rows.join(secrets, F.col(f"s_row.`{id_col}`").cast("long").eqNullSafe(F.col("s_doc_id")) & (F.xxhash64(text) == F.col("s_text_hash")), "left")
    new = joined.withColumn("s_text", F.when(F.col("s_spans").isNotNull(), cover(text, F.col("s_spans"))).otherwise(text))
    values = {c: F.col(f"s_row.`{c}`") for c in docs.columns} | {text_col: F.col("s_text")}
    if chars_col in docs.columns:
        values[chars_col] = F.when(F.col("s_spans").isNotNull(), F.char_length("s_text").cast(docs.schema[chars_col].dataType)).otherwise(values[chars_col])
    return new.select(*(v.alias(c) for c, v in values.items()))
