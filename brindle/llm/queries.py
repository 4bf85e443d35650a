"""The registered queries opN_<name> and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, media, mixing, near_dedup, packing, quality, secrets, tokens, toxicity
from .oracles import ORACLE_SQL
from .shared import documents, labels, scratch_path


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.texts_to_media(documents(spark, sf_dir))
    read = media.media_features(stored, ("doc_id", "n_bytes"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    best = F.array_max(F.transform("spans", lambda s: s["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=2, threshold=80)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode(documents(spark, sf_dir))
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(encoded, path)
    return tokens.token_digests(tokens.read_tokens(spark, path, encoded.schema))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a ledger: the documents of the lower ids as what was there before, then all of them."""
    docs = documents(spark, sf_dir)
    ledger = secrets.Ledger(spark, scratch_path(spark, "ledger"))
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if span["a"] is not None:
        ledger.run(docs.where(F.col("doc_id") <= (span["a"] + span["b"]) // 2))
    ledger.run(docs)
    found = secrets.path_findings(docs, ("doc_id",), ledger.findings)
    base = F.filter("found", lambda x: x["rank"] < len(secrets.BASE_RULES))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secrets.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, sf_dir))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_media": op1_media,
    "op2_licenses": op2_licenses,
    "op3_near_dedup": op3_near_dedup,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
}
