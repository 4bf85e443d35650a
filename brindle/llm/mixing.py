"""Mixing sources to target weights: capped water-filling, in DataFrame operations only.

Every source has a weight; a target is its share of the whole size, but at most ``epochs`` times
what the source holds.  What the capped sources cannot take is shared among the others by weight,
again and again until none is above its cap.  The limit of that process is a water level L with
target = min(cap, weight * L), and L is found exactly by one sorted pass over the sources: those
with the smallest cap per weight fill up first.

A source repeats all of its documents floor(target / size) times.  The rest, less than one
repetition, takes documents whole in a seeded order until the next would overshoot; that one is
taken in part.  The order comes from a hash of seed and id, and is found in two steps (the sums of
hash buckets, then the order within each bucket), so no source is ever sorted in one task.

Cases: a null text has size 0, a null source is a source of its own (last), a source without words
gets target 0; repeated rows are separate documents with the same hash, told apart by rank; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Words of the size rule, and the weights dealt to the sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the hash that name a bucket: 16**3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_level(sources: DataFrame, weight: str = "weight", size: str = "source_size", epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (one row each: a bounded dimension) with ``target``."""
    cap = F.col(size) * epochs
    by_fill = Window.orderBy(F.col("__cap") / F.col(weight), weight, "__rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sources.withColumn("__cap", cap).withColumn("__all", F.sum(size).over(Window.partitionBy()))
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))).cast("double") / F.sum(weight).over(after)
    out = out.withColumn("__level", level)
    # the first source whose share fits below its cap sets the level for itself and all after it
    fits = F.when(F.col("__level") * F.col(weight) <= F.col("__cap"), F.col("__level"))
    first = F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(first.isNull(), F.col("__cap").cast("double")).otherwise(first * F.col(weight))
    return out.withColumn("target", target).drop("__cap", "__all", "__level")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, repeats, part, taken), one row for each document.

    ``repeats`` whole copies and the first ``part`` words of one more are in the mix;
    ``taken`` = repeats * size + part.  ``carry`` names further columns to keep.
    """
    sized = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("__h"),
        word_count(text_or_empty(text_col)).alias("size"),
        *carry,
    )
    bucket = F.substring("__h", 1, BUCKET_DIGITS)
    # sums of each hash bucket, then of each source: small tables made by map-side sums
    buckets = sized.groupBy("__source", bucket.alias("__b")).agg(F.sum("size").alias("__n"))
    sources = buckets.groupBy("__source").agg(F.sum("__n").alias("source_size"))
    ranked = sources.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    pick = F.lit(weights[-1])
    for k, w in enumerate(weights):
        pick = F.when((F.col("__rank") - 1) % len(weights) == k, F.lit(w)).otherwise(pick)
    targets = water_level(ranked.withColumn("weight", pick), epochs=epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select("__source", "source_size", "target", whole.cast("long").alias("__whole")).withColumn(
        "__left", (F.round("target") - F.col("__whole") * F.col("source_size")).cast("long")
    )
    # where in the seeded order of buckets each one begins
    ordered = Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("__before", F.coalesce(F.sum("__n").over(ordered), F.lit(0)))
    cuts = starts.join(targets, starts["__source"].eqNullSafe(targets["__source"])).select(
        starts["__source"].alias("__s"), "__b", "source_size", "target", "__whole", (F.col("__left") - F.col("__before")).alias("__room"), "__n"
    )
    placed = sized.join(cuts, sized["__source"].eqNullSafe(cuts["__s"]) & (bucket == cuts["__b"]))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("__room") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.greatest(room, F.lit(0)), F.col("size"))
    return placed.withColumn("__part", part).select(
        F.col("__id").alias(id_col),
        F.col("__s").alias(source_col),
        *carry,
        "size",
        "source_size",
        "target",
        F.col("__whole").alias("repeats"),
        F.col("__part").alias("part"),
        (F.col("__whole") * F.col("size") + F.col("__part")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last time perhaps only its first words."""
    names = docs.columns
    inner = docs.select(F.col(id_col).alias("__i"), F.col(source_col).alias("__src"), F.col(text_col).alias("__t"), F.struct(*names).alias("__row"))
    plan = mix(inner, "__i", "__t", "__src", carry=("__row",), **options)
    text = F.col("__row")[text_col]
    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(1), F.col("repeats"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.when(F.col("part") > 0, F.array_append(copies, F.lit(0).cast("long"))).otherwise(copies)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    reach = lambda parts: F.aggregate(F.slice(F.transform(parts, F.length), 1, F.col("part").cast("int")), F.lit(0), lambda n, x: n + x)
    piece = F.substring(text, F.lit(1), reach(F.split(text, WORD)) + reach(words))
    cut = (F.col("__copy") == 0) & (F.col("part") < F.col("size"))
    each = plan.withColumn("__copy", F.explode(copies)).withColumn("__text", F.when(cut, piece).otherwise(text))
    return each.select(*(F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names))
