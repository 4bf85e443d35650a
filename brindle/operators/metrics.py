"""Session metrics and diagnostics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab

#: Slices of a group's range of values that are ordered on their own.
SLICES = 64


def session_report(sessions: DataFrame) -> DataFrame:
    """Overall and per scenario: count, hit rate, mean reciprocal rank, mean turns to a hit, efficiency and composite.

    ``sessions`` has (scenario, hit_turn, hit_rank), null where there was no hit; the overall row has
    a null scenario.  Without any session there is still the overall row: zeros, and no mean of turns.
    """
    turns = F.coalesce(F.col("hit_turn"), F.lit(vocab.MAX_TURNS + 1))
    rates = sessions.groupingSets([[], ["scenario"]], "scenario").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("hit_turn").isNotNull().cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(turns), 6).alias("mttc"),
    )
    name = sessions.schema["scenario"].dataType
    nothing = F.struct(F.lit(None).cast(name).alias("scenario"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("hit_rate"), F.lit(0.0).alias("mrr"), F.lit(None).cast("double").alias("mttc"))
    none = sessions.agg(F.count(F.lit(1)).alias("all")).where("all = 0").select(nothing.alias("r")).select("r.*")
    return scored_report(rates.unionByName(none))


def scored_report(rates: DataFrame) -> DataFrame:
    turns = F.coalesce("mttc", F.lit(float(vocab.MAX_TURNS + 1)))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vocab.MAX_TURNS + 1 - turns) / 10))
    out = rates.withColumn("efficiency", F.round(clipped, 6))
    return out.withColumn("score", F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6))


def evaluated(results: DataFrame, truth: DataFrame, settings: DataFrame) -> DataFrame:
    """(setting, hit_rate, mrr, delta) of ranked (setting, query_id, doc_id, rank) against (query_id, doc_id).

    Every query that has something to find counts under every setting (a fixed list); ``delta`` is
    the gain in reciprocal rank over the first setting.
    """
    best = results.join(truth, ["query_id", "doc_id"]).groupBy("setting", "query_id").agg(F.min("rank").alias("r"))
    asked = truth.select("query_id").distinct().crossJoin(F.broadcast(settings.select("setting")))
    joined = asked.join(best, ["setting", "query_id"], "left")
    m = joined.groupBy("setting").agg(F.round(F.avg(F.col("r").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
    return m.select("setting", "hit_rate", "mrr", F.round(F.col("mrr") - F.first("mrr").over(Window.orderBy("setting")), 6).alias("delta"))


def coordinate_descent(evaluate: Callable[[list[list[float]]], list[float]], start: list[float], factors: tuple[float, ...] = (0.5, 2.0)) -> tuple[list[float], list[tuple[list[float], float]]]:
    """The weights reached from ``start`` by trying every factor on every coordinate in turn, keeping strict gains.

    ``evaluate`` scores a list of settings in one job; a coordinate's factors are tried together, so
    the driver makes one job a coordinate.  A weight of 0 cannot be scaled and is passed over.
    """
    (best,) = evaluate([start])
    log = [(list(start), best)]
    for k, w in enumerate(start):
        if not w:
            continue
        tries = [start[:k] + [start[k] * f] + start[k + 1 :] for f in factors]
        scores = evaluate(tries)
        log += list(zip(tries, scores))
        top = max(range(len(tries)), key=lambda i: scores[i])
        if scores[top] > best:
            best, start = scores[top], tries[top]
    return start, log


def confusion(rows: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """Counts, recall, false-positive rate and precision (null where undefined)."""
    n = lambda c: F.count(F.when(c, 1))
    counts = rows.groupBy(*keys).agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(~truth & ~predicted).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 6)
    return counts.select("*", rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("fpr"), rate("tp", "fp").alias("precision"))


def running_counts(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, c, upto, n): every value of a group with how often it occurs, how many rows are up to it, and in all.

    Equal values are counted before anything is ordered, and groups of many values are ordered in
    SLICES slices of their value ranges, so no group is sorted in one task.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    ends = c.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("c").alias("n"))
    placed = _beside(c, ends, keys)
    share = F.try_divide((F.col(value) - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double"))
    placed = placed.withColumn("__slice", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * SLICES), F.lit(SLICES - 1)).cast("int")).drop("__lo", "__hi")
    sums = placed.groupBy(*keys, "__slice").agg(F.sum("c").alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).drop("__c")
    both = _beside(placed, sums, (*keys, "__slice"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("upto", F.col("__before") + F.sum("c").over(inside)).select(*keys, value, "c", "upto", "n")


def _beside(rows: DataFrame, more: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with the other columns of their (possibly null) keys."""
    on = F.lit(True)
    for k in keys:
        more = more.withColumnRenamed(k, f"__of_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(more, on).drop(*(f"__of_{k}" for k in keys))


def value_at(value: str, place: Column) -> Column:
    """Aggregate over ``running_counts``: the value at a place (from 0) of the sorted rows."""
    return F.min(F.when(F.col("upto") > place, F.col(value)))


def quartile_cuts(rows: DataFrame, value: str) -> DataFrame:
    """One row: the values at places n // 4, n // 2 and 3 * n // 4 of the sorted column."""
    at = lambda k: value_at(value, F.floor(F.col("n") * k / 4))
    return running_counts(rows, value).agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median, p95 by place in the sorted values (no interpolation; the maximum below 20 values), maximum."""
    n = F.col("n")
    p95 = F.when(n >= 20, F.floor(n * 0.95) - 1).otherwise(n - 1)
    median = (value_at(value, F.floor((n - 1) / 2)) + value_at(value, F.floor(n / 2))) / 2
    total = F.sum(F.col(value) * F.col("c")) / F.max("n")
    counts = running_counts(rows, value, *keys)
    return counts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.round(total, 1).alias("mean"), F.round(median, 1).alias("p50"), F.round(value_at(value, p95), 1).alias("p95"), F.round(F.max(value), 1).alias("max")
    )


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, upper_median): the value at place n // 2 of the sorted ones."""
    return running_counts(rows, value, *keys).groupBy(*keys).agg(F.max("n").alias("n"), value_at(value, F.floor(F.col("n") / 2)).alias("upper_median"))


def medians(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, median): the middle value, or the mean of the two in the middle."""
    n = F.col("n")
    middle = (value_at(value, F.floor((n - 1) / 2)) + value_at(value, F.floor(n / 2))) / 2
    return running_counts(rows, value, *keys).groupBy(*keys).agg(F.max("n").alias("n"), middle.cast("double").alias("median"))


def threshold_choice(rows: DataFrame, thresholds: list[tuple[int, float]]) -> DataFrame:
    """(k, precision, template_recall, other_recall, chosen) of every threshold, in one pass over (pool, value).

    ``pool`` is "answer" (must not be flagged), "template" (must be) or "other" (should be).  Chosen is
    the threshold with the best sum of precision and other recall among those that catch every
    template, the first of equals; none if no threshold does.
    """
    n = lambda c: F.count(F.when(c, 1)).cast("double")

    def one(k: int, t: float) -> Column:
        share = lambda p: F.try_divide(n((F.col("pool") == p) & (F.col("value") > t)), n(F.col("pool") == p))
        return F.struct(F.lit(k).alias("k"), F.round(1 - share("answer"), 6).alias("precision"), F.round(share("template"), 6).alias("template_recall"), F.round(share("other"), 6).alias("other_recall"))

    points = rows.agg(F.array(*(one(k, t) for k, t in thresholds)).alias("a")).select(F.inline("a"))
    whole = F.col("template_recall") == 1
    best = F.row_number().over(Window.orderBy(F.desc_nulls_last(whole), F.desc_nulls_last(F.round(F.col("precision") + F.col("other_recall"), 9)), "k"))
    return points.withColumn("chosen", whole & (best == 1))


def marginals(values: DataFrame) -> DataFrame:
    """(attribute, value, n, total, kinds) of long-form (id, attribute, value)."""
    n = values.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = n.groupBy("attribute").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))  # one row an attribute
    return n.join(F.broadcast(sums), "attribute")


def joint_counts(values: DataFrame) -> DataFrame:
    """(given, evidence, target, value, joint) for all ordered pairs of different attributes of a row."""
    rows = values.groupBy("id").agg(F.collect_list(F.struct("attribute", "value")).alias("vs"))  # a few attributes a row
    one = rows.select("vs", F.explode("vs").alias("e")).select("e", F.explode("vs").alias("t")).where("e.attribute <> t.attribute")
    return one.groupBy(F.col("e.attribute").alias("given"), F.col("e.value").alias("evidence"), F.col("t.attribute").alias("target"), F.col("t.value").alias("value")).agg(F.count(F.lit(1)).alias("joint"))


def cooccurrence(values: DataFrame, least: int = 50) -> DataFrame:
    """(given, evidence, target, value, joint, support, posterior, lift) of the pairs seen; evidence with less support is left out.

    A pair that is not in the result has joint 0, and the posterior 1 / (support + kinds) of its target.
    """
    m = marginals(values)
    given = m.where(F.col("n") >= least).select(F.col("attribute").alias("given"), F.col("value").alias("evidence"), F.col("n").alias("support"))
    target = m.select(F.col("attribute").alias("target"), "value", "n", "total", "kinds")
    both = joint_counts(values).join(given, ["given", "evidence"]).join(target, ["target", "value"])
    posterior = (F.col("joint") + 1.0) / (F.col("support") + F.col("kinds"))
    return both.select("given", "evidence", "target", "value", "joint", "support", F.round(posterior, 6).alias("posterior"), F.round(posterior / (F.col("n") / F.col("total")), 6).alias("lift"))


def predicted_values(lifts: DataFrame, least: float = 1.5) -> DataFrame:
    """(given, evidence, target, predicted, lift): the value of the best lift, null if that is not above ``least``."""
    place = F.row_number().over(Window.partitionBy("given", "evidence", "target").orderBy(F.desc("lift"), "value"))
    best = lifts.withColumn("place", place).where("place = 1")
    return best.select("given", "evidence", "target", F.when(F.col("lift") > least, F.col("value")).alias("predicted"), "lift")


def naive_bayes(values: DataFrame, target: str, least: int = 50) -> DataFrame:
    """(id, guess, k): each row's likeliest value of ``target`` given all its other attributes with enough support, ``k`` of them.

    The likelihoods P(evidence | value) are smoothed by one.  Every row starts from the scores of
    unseen pairs, which are the same for all rows of as many pieces of evidence, and only the values
    that were seen with some of its evidence are corrected, so no grid of rows and values is made.
    """
    m = marginals(values)
    t = m.where(F.col("attribute") == target).select("value", "n", "total")
    evidence = values.where(F.col("attribute") != target).join(m.where(F.col("n") >= least).select("attribute", "value", "kinds"), ["attribute", "value"])
    keys = evidence.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("attribute", "value", "kinds"))).alias("es"))
    kinds = keys.select("es").distinct()  # distinct combinations of evidence, each scored once
    seen = joint_counts(values).where(F.col("target") == target).select("given", "evidence", "value", "joint")
    parts = kinds.select("es", F.explode("es").alias("e")).select("es", F.col("e.attribute").alias("given"), F.col("e.value").alias("evidence"), F.col("e.kinds").alias("kinds"))
    gain = F.log((F.col("joint") + 1.0) / (F.col("n") + F.col("kinds"))) - F.log(1.0 / (F.col("n") + F.col("kinds")))
    met = parts.join(seen, ["given", "evidence"]).join(t, "value").groupBy("es", "value").agg(F.sum(gain).alias("gain"))
    spread = parts.groupBy("es").agg(F.collect_list("kinds").alias("all"))
    base = F.aggregate("all", F.log(F.col("n") / F.col("total")), lambda s, x: s + F.log(1.0 / (F.col("n") + x)))
    grid = spread.crossJoin(F.broadcast(t)).select("es", "value", base.alias("base"))  # combinations by target values, a vocabulary
    score = F.round(F.col("base") + F.coalesce("gain", F.lit(0.0)), 9)
    place = F.row_number().over(Window.partitionBy("es").orderBy(F.desc("score"), "value"))
    best = grid.join(met, ["es", "value"], "left").withColumn("score", score).withColumn("place", place).where("place = 1")
    return keys.join(best.select("es", F.col("value").alias("guess")), "es").select("id", "guess", F.size("es").cast("long").alias("k"))


def band(x: Column, edges: tuple[float, ...]) -> Column:
    """The index of the half-open band that holds ``x``."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        out = F.when((x >= edges[k]) & (x < edges[k + 1]), k).otherwise(out)
    return out
