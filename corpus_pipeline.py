"""A corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of ``documents``; the last one returns the packed sequences.  Stages are written as Parquet
in the shared folder and read again, so a lost executor costs a part of one stage only.

Cases, for every stage: null and empty texts go through (the classifier judges them by its bias
alone, no stage links, redacts or repeats them); null and repeated ids are rows of their own; ties
are broken by id or text; further columns, whatever their names, are kept by all stages but the
last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_dedup, packing, quality, secrets
from brindle.llm.shared import documents, labels, written


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after a change of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, docs, labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five-word shingles, similarity 0.8)."""
    return near_dedup.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return _with_length(secrets.redacted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and sampled to their target weights."""
    return _with_length(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the permitted lengths, with the document, copy and place of every piece."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the signatures or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
