"""Detectors on sentence vectors: nearest centroids, nearest prototypes, and the encoder that makes the vectors.

Any encoder can be injected (``encoded``); the rules themselves are native expressions on arrays.
Prototype and centroid sides are collected into one row a label and counted before they are sent out.

Cases: a null vector has no similarity and leans to nothing (browsing, no override, an answer); a
centroid of length zero is not divided; labels without prototypes are absent; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import vocab
from .retrieval import dot, norm, top_n

#: Labels that are sent to all tasks; more are joined.
MOST_LABELS = 10_000


def encoded(texts: DataFrame, encoder: Callable[[pd.Series], pd.Series], text: str = "text", to: str = "v") -> DataFrame:
    """``texts`` with the vector of a column, by an Arrow-batched function; a failing encoder gives nulls."""

    def safe(batch: pd.Series) -> pd.Series:
        try:
            return encoder(batch)
        except Exception:
            return pd.Series([None] * len(batch))

    return texts.withColumn(to, F.pandas_udf(safe, "array<double>")(F.col(text)))


def _small(labels: DataFrame) -> DataFrame:
    """One row a label, sent out only if they are few."""
    return F.broadcast(labels) if labels.limit(MOST_LABELS + 1).count() <= MOST_LABELS else labels


def centroids(rows: DataFrame) -> DataFrame:
    """(label, c): the mean vector of every label, at length one."""
    m = rows.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c"))
    length = norm(F.col("c"))
    return c.select("label", F.transform("c", lambda x: F.coalesce(F.try_divide(x, length), x)).alias("c"))


def nearest_centroid(rows: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, v, ...) with the ``guess`` and ``score`` of the likest mean; the smaller label of equals."""
    u = _small(means.withColumnRenamed("label", "guess"))
    s = rows.crossJoin(u).withColumn("score", F.round(dot(F.col("v"), F.col("c")), 6)).drop("c")
    return top_n(s, 1, F.desc("score"), F.col("guess"), key=key).drop("rank")


def prototype_scores(rows: DataFrame, prototypes: DataFrame, k: int = vocab.TOP_PROTOTYPES, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keep, label, score): for every row and label the mean similarity to its ``k`` likest prototypes (label, v)."""
    p = _small(prototypes.groupBy("label").agg(F.collect_list(F.col("v").cast("array<double>")).alias("ps")))  # a declared number a label
    sims = F.slice(F.sort_array(F.transform("ps", lambda c: dot(F.col("v"), c)), asc=False), 1, k)
    mean = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / F.size(sims)
    return rows.crossJoin(p).select(*keep, "label", F.round(mean, 6).alias("score"))


def intent(rows: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, score, label): similarity to the buying centroid less that to the browsing one; above 0 is buying."""
    c = centroids(prototypes)
    both = c.groupBy().agg(*(F.max(F.when(F.col("label") == x, F.col("c"))).alias(x) for x in ("buying", "browsing")))
    score = F.round(dot(F.col("v"), F.col("buying")) - dot(F.col("v"), F.col("browsing")), 6)
    out = rows.crossJoin(F.broadcast(both)).select(key, F.coalesce(score, F.lit(0.0)).alias("score"))  # one row
    return out.withColumn("label", F.when(F.col("score") > 0, "buying").otherwise("browsing"))


def votes(scores: DataFrame, key: str, threshold: float = vocab.NON_ANSWER_SIMILARITY) -> DataFrame:
    """(key, override, non_answer) from (key, label, score): which class's prototypes a turn leans to.

    An override is likelier than continuation, buying and browsing; a non-answer is near enough to its own.
    """
    of = lambda *names: F.max(F.when(F.col("label").isin(*names), F.col("score")))
    lean = F.coalesce(of("override") > of("continuation", "buying", "browsing"), F.lit(False))
    return scores.groupBy(key).agg(lean.alias("override"), F.coalesce(of("non_answer") > threshold, F.lit(False)).alias("non_answer"))


def turn_variants(turns: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, text): a turn and, if it differs, its lead clause; either may lean to an override."""
    lead = ex.lead_clause(F.col("text"))
    both = F.when(F.coalesce(lead != F.col("text"), F.lit(False)), F.array("text", lead)).otherwise(F.array("text"))
    return turns.select(key, F.explode(both).alias("text"))


def detected(turns: DataFrame, prototypes: DataFrame, encoder: Callable[[pd.Series], pd.Series], key: str = "turn_id") -> DataFrame:
    """(key, override, non_answer) of turns (key, text) by cues first and vectors after them.

    A closed cue makes an override without a vector; a stated attribute vetoes a non-answer; blank
    turns are neither.  Without vectors (a failing encoder) the lexical rules stand alone.
    """
    text = F.col("text")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    plain = turns.select(
        key, "text", blank.alias("blank"), F.coalesce(ex.override_cue(text), F.lit(False)).alias("cue"), (F.size(ex.detected_attributes(text)) > 0).alias("veto"), (ex.reply_class(text) == "non_answer").alias("lexical"),
    )
    open_turns = plain.where(~F.col("blank") & ~(F.col("cue") & F.col("veto"))).select(key, "text")
    own = votes(prototype_scores(encoded(open_turns, encoder), prototypes, keep=(key,)).where("score is not null"), key)
    leads = votes(prototype_scores(encoded(turn_variants(open_turns, key), encoder), prototypes, keep=(key,)).where("score is not null"), key)
    both = plain.join(own.select(key, "non_answer"), key, "left").join(leads.select(key, "override"), key, "left")
    override = ~F.col("blank") & (F.col("cue") | F.coalesce("override", F.lit(False)))
    non_answer = ~F.col("blank") & ~F.col("veto") & F.coalesce("non_answer", "lexical")
    return both.select(key, override.alias("override"), non_answer.alias("non_answer"))


def folded_accuracy(rows: DataFrame, key: str) -> DataFrame:
    """(fold, n, accuracy) of nearest centroids on (key, truth, v, fold), each fold judged by the means of the others.

    The sums of all folds less a fold's own give its means, so the vectors are read once.
    """
    s = rows.select("fold", F.col("truth").alias("label"), F.posexplode("v").alias("dim", "x")).groupBy("fold", "label", "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = s.groupBy("label", "dim").agg(F.sum("x").alias("all"))
    folds = rows.select("fold").distinct()  # a fixed number
    rest = whole.crossJoin(F.broadcast(folds)).join(s, ["fold", "label", "dim"], "left").withColumn("x", F.col("all") - F.coalesce("x", F.lit(0.0)))
    c = rest.groupBy("fold", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda t: t["x"]).alias("c"))
    score = F.round(F.try_divide(dot(F.col("v"), F.col("c")), norm(F.col("c"))), 6)
    judged = rows.join(_small(c.withColumnRenamed("label", "guess")), "fold").withColumn("score", score)
    best = top_n(judged, 1, F.desc("score"), F.col("guess"), key=key)
    return best.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("accuracy"))


def logistic_head(rows: DataFrame, strengths: list[float]) -> DataFrame:
    """(c, n, accuracy) of logistic regressions on (y, v, held_out) for inverse regularisations ``c``, judged on the held-out rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select("held_out", F.col("y").cast("double").alias("label"), array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    out = None
    for c in strengths:
        model = LogisticRegression(regParam=1.0 / c, maxIter=50).fit(data.where(~F.col("held_out")))
        judged = model.transform(data.where("held_out"))
        part = judged.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("accuracy")).select(F.lit(c).alias("c"), "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out
