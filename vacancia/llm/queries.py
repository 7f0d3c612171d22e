"""Queries of the operators over the given tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, merkle, minhash, oracles, packing, quality, secrets, sentencepieces, sharding, sketches, substrings, token_files, toxicity
from .shared import read_table


def bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read_table(spark, sf_dir, "documents"), bpe_path(), end_id=2)
    return token_files.read_token_files(manifest)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, bpe_path(), end_id=0)
    sizes = pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(sizes, docs.count(), key_cols=("doc_id", "start", "ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.with_decision(scored, 0.3)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_neighbours(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.with_decision(scored, 0.5)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    def of(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = (of(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3]))
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(read_table(spark, sf_dir, "documents"), bpe_path(), piece_path())


def sentencepiece_digest(docs: DataFrame) -> DataFrame:
    encoded = sentencepieces.encode_pieces(docs, piece_path())
    decoded = sentencepieces.decode_pieces(encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids"), piece_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(read_table(spark, sf_dir, "documents"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    return merkle.manifest(docs, tampered={"text": F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)})


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_quality, op3_fingerprints, op4_toxicity, op5_sharding, op6_packing, op7_decontamination, op8_substrings, op9_near_duplicates, op10_secrets, op11_alignment, op12_sentencepiece, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op7_decontamination": oracles.OP7, "op8_substrings": oracles.OP8, "op9_near_duplicates": oracles.OP9, "op13_merkle": oracles.OP13}
