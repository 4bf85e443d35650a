"""Readers and writers: product catalogs, sessions, dense indexes, profile stores, reports.

Schemas are declared, never inferred, so a scan is one pass and columns prune; every reader takes a
path that Spark's file systems can open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = (
    "parent_asin string, title string, features array<string>, description array<string>, price double, categories array<string>, "
    "details map<string,string>, average_rating double, rating_number bigint, store string"
)
SESSIONS = (
    "sample_id string, scenario_type string, user_profile struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>, "
    "ground_truth struct<parent_asin:string>, difficulty_bucket string"
)
_BAD = "__bad"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones become rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_checked(spark: SparkSession, path: str, schema: str, key: str, limit: int | None = None) -> DataFrame:
    """Like ``read_jsonl``, but a malformed line or a missing key fails the job with the line itself."""
    rows = spark.read.schema(f"{schema}, {_BAD} string").option("columnNameOfCorruptRecord", _BAD).json(path)
    broken = F.when(F.col(_BAD).isNotNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.left(_BAD, F.lit(200)))))
    missing = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.lit(f"a line has no {key}")))
    checked = rows.where(F.coalesce(broken, missing).isNull()).drop(_BAD)
    return checked.limit(limit) if limit else checked


def lookup(catalog: DataFrame, ids: DataFrame, key: str = "parent_asin") -> DataFrame:
    """(key, text) of the wanted rows: title, categories and features joined."""
    text = F.concat_ws(" ", "title", F.array_join("categories", " "), F.array_join("features", " "))
    return catalog.join(ids.select(key).distinct(), key, "left_semi").select(key, text.alias("text"))


def write_index(vectors: DataFrame, path: str, model: str, source_digest: str) -> None:
    """(id, embedding) as Parquet beside one row of what it was made from."""
    vectors.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = vectors.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("embedding")).alias("dim"))
    meta.select(F.lit(model).alias("model"), F.lit(source_digest).alias("source_digest"), "count", "dim").write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, model: str, source_digest: str) -> DataFrame:
    """The vectors, or ValueError if the index is of another model, stale, or incomplete."""
    (meta,) = spark.read.parquet(f"{path}/meta").collect()  # one row
    if (meta["model"], meta["source_digest"]) != (model, source_digest):
        raise ValueError("the index was made from another model or source")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != meta["count"]:
        raise ValueError("the index is incomplete")
    return vectors


def append_disclosures(rows: DataFrame, path: str) -> None:
    """Add (key, attribute, value, session) rows to a profile store; appends are atomic per job."""
    rows.select("key", "attribute", "value", "session").write.mode("append").parquet(path)


def carried_values(store: DataFrame, least: int = 2) -> DataFrame:
    """(key, attribute, value): what a profile disclosed most often, at least ``least`` times; first seen wins ties.

    Every disclosure counts, also a second one in the same session.
    """
    n = store.groupBy("key", "attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("key", "attribute").orderBy(F.desc("n"), "first", "value"))
    return n.withColumn("place", place).where("place = 1").select("key", "attribute", "value")


def write_report(sessions: DataFrame, report: DataFrame, path: str) -> None:
    """Per-session rows and the summary as JSON."""
    sessions.write.mode("overwrite").json(f"{path}/sessions")
    report.write.mode("overwrite").json(f"{path}/report")


def log_point(point: DataFrame, path: str, setting: str) -> None:
    """One evaluated setting of a sweep, as a partition of its log: a point that is run again replaces itself."""
    point.write.mode("overwrite").json(f"{path}/setting={setting}")


def replay_picks(turns: DataFrame, cards: DataFrame) -> DataFrame:
    """Of every scenario the session with the earliest hit, and one that missed, with their targets' cards.

    ``turns`` has (session, scenario, target, hit_turn); ``cards`` has (target, title).
    """
    s = turns.groupBy("session", "scenario", "target").agg(F.min("hit_turn").alias("hit_turn"))
    place = F.row_number().over(Window.partitionBy("scenario", F.col("hit_turn").isNull()).orderBy("hit_turn", "session"))
    best = s.withColumn("place", place).where("place = 1").drop("place")
    one_miss = F.row_number().over(Window.partitionBy(F.col("hit_turn").isNull()).orderBy("session"))
    kept = best.withColumn("k", one_miss).where(F.col("hit_turn").isNotNull() | (F.col("k") == 1)).drop("k")
    return kept.join(cards, "target", "left")
