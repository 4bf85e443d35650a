"""Question policy: pool entropy, answerability beliefs, the weighted picker, routing parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def pool_entropy(values: DataFrame, pool: str = "pool", value: str = "value") -> DataFrame:
    """(pool, attribute, entropy): Shannon entropy over the log of the number of distinct values; null is a value."""
    n = values.groupBy(pool, "attribute", value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(pool, "attribute"))
    p = F.col("n") / F.col("total")
    h = n.withColumn("total", total).groupBy(pool, "attribute").agg((-F.sum(p * F.log2(p))).alias("h"), F.count(F.lit(1)).alias("kinds"))
    return h.select(pool, "attribute", F.when(F.col("kinds") < 2, F.lit(0.0)).otherwise(F.round(F.try_divide("h", F.log2("kinds")), 6)).alias("entropy"))


def weighted_question(entropy: DataFrame, answerable: DataFrame, least: float, pool: str = "pool", entropy_weight: float = 1.0, answer_weight: float = 1.0) -> DataFrame:
    """(pool, attribute, score): of every pool the attribute with the best weighted mean of both; first listed wins ties.

    ``answerable`` has (attribute, ord, p); entropies of at most ``least`` do not count, and an
    attribute known from one side only has that side's value.
    """
    pools = entropy.select(pool).distinct()
    both = pools.crossJoin(F.broadcast(answerable)).join(entropy.where(F.col("entropy") > least), [pool, "attribute"], "left")
    e, a = F.col("entropy"), F.col("p")
    mean = F.try_divide(entropy_weight * e + answer_weight * a, F.lit(entropy_weight + answer_weight))
    score = F.round(F.when(e.isNull(), a).when(a.isNull(), e).otherwise(mean), 6)
    place = F.row_number().over(Window.partitionBy(pool).orderBy(F.desc_nulls_last("score"), "ord"))
    return both.withColumn("score", score).withColumn("place", place).where("place = 1 and score is not null").select(pool, "attribute", "score")


def bayes(p: Column, ratio: Column) -> Column:
    """A probability after its odds are multiplied; 0, 1 and a ratio of 1 change nothing."""
    odds = p / (1 - p) * ratio
    return F.when((p <= 0) | (p >= 1) | (ratio == 1), p).otherwise(odds / (1 + odds))


def belief(observed: DataFrame, key: str = "session") -> DataFrame:
    """(session, attribute, p) after all questions of a session: (session, seq, asked, answered).

    Asked attributes are exhausted.  All others multiply their odds by the ratio of each answer, or
    divide by it after a non-answer; as factors commute, the fold is one sum of logarithms.
    """
    ratios = [(a, b, r) for a, row in vocab.ANSWER_ODDS.items() for b, r in row.items()]
    spark = observed.sparkSession
    odds = spark.createDataFrame(ratios, "asked string, attribute string, ratio double")
    prior = spark.createDataFrame(list(vocab.ANSWERABILITY.items()), "attribute string, prior double")
    sessions = observed.select(key).distinct().crossJoin(F.broadcast(prior))  # seven attributes
    gone = observed.where(F.col("asked").isNotNull()).select(key, F.col("asked").alias("attribute")).distinct().withColumn("gone", F.lit(True))
    moved = observed.join(F.broadcast(odds), "asked").groupBy(key, "attribute").agg(F.sum(F.when(F.col("answered"), F.log("ratio")).otherwise(-F.log("ratio"))).alias("moved"))
    out = sessions.join(moved, [key, "attribute"], "left").join(gone, [key, "attribute"], "left")
    p = F.when(F.col("gone"), F.lit(0.0)).otherwise(bayes(F.col("prior"), F.exp(F.coalesce("moved", F.lit(0.0)))))
    return out.select(key, "attribute", F.round(p, 6).alias("p"))


def routing(label: Column, boundary: Column) -> Column:
    """Weights and switches for a turn, by intent and whether the customer handed the decision back."""
    buying = label == "buying"
    number = lambda yes, no: F.when(buying, yes).otherwise(no)
    return F.struct(
        number(2.0, 1.25).alias("bm25"), F.lit(1.5).alias("dense"), F.lit(2.0).alias("phrase"), F.lit(0.5).alias("feedback"),
        F.when(boundary, 1.0).otherwise(0.5).alias("popularity"), number(0.10, 0.30).alias("least_entropy"),
        (~buying | boundary).alias("diversify"), (buying | boundary).alias("repel"), F.when(boundary, 0.35).otherwise(0.5).alias("trade"),
    )


def softmax_entropy(scores: DataFrame, key: str, confident: float = 0.60) -> DataFrame:
    """(key, value, p) with the normalised entropy of each key's softmax, and whether it is confident."""
    w = Window.partitionBy(key)
    e = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("n", F.count(F.lit(1)).over(w))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    h = -F.sum(F.col("p") * F.log2("p")).over(w)
    entropy = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.try_divide(h, F.log2("n")))
    return p.withColumn("entropy", F.round(entropy, 6)).select(key, "value", F.round("p", 6).alias("p"), "entropy", (F.col("entropy") < confident).alias("confident"))
