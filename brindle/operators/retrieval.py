"""Retrieval legs over DataFrames: weighted-field BM25, phrases, dense vectors, feedback, popularity, fusion.

A leg takes queries keyed by ``query_id`` and returns (query_id, doc_id, rank, score).  Queries are
collected in blocks of a fixed size and bound to a kernel (``scan``); of the corpus, only the first
rows of each query and partition shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vocab
from . import scan

#: Query vectors that are sent to all tasks at once.
BLOCK_QUERIES = 4096


def top_n(scored: DataFrame, n: int, *order: Column, key: str = "query_id") -> DataFrame:
    """The first ``n`` rows of every key with their rank; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def query_terms(queries: DataFrame, text: str = "text", most: int | None = vocab.MAX_QUERY_TERMS) -> DataFrame:
    """(query_id, term): the first ``most`` distinct terms of each query, or all."""
    every = F.array_distinct(tx.terms(F.coalesce(F.col(text), F.lit(""))))
    return queries.select("query_id", F.explode(every if most is None else F.slice(every, 1, most)).alias("term"))


def query_grams(queries: DataFrame, text: str = "text", sizes: tuple[int, ...] = vocab.GRAM_SIZES, budget: int = vocab.MAX_GRAMS) -> DataFrame:
    """(query_id, k, gram): the runs of each query's tokens that are looked up, in order."""
    tokens = tx.phrase_tokens(F.coalesce(F.col(text), F.lit("")))
    return queries.select("query_id", F.posexplode(tx.query_grams(tokens, sizes, budget)).alias("k", "gram"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dense(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Nearest vectors by dot product: queries (query_id, q) against all (doc_id, v), in blocks.

    Queries are counted and dealt into blocks of about BLOCK_QUERIES, the only thing that is sent to
    the tasks; each block is one pass over the vectors, and only the first ``n`` rows of a query
    leave a partition.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    schema = T.StructType([queries.schema["query_id"], vectors.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out = None
    for k in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "q").toArrow()
        part = scan.over(vectors.select("doc_id", "v"), scan.dense_kernel(block, n), schema)
        out = part if out is None else out.unionByName(part)
    return top_n(out.select("query_id", "doc_id", "score"), n, F.desc("score"), F.col("doc_id"))


def repelled(pool: DataFrame, shown: DataFrame) -> DataFrame:
    """``pool`` (query_id, doc_id, rank, vector) with ``repel``: the largest similarity to what the query was shown, -1e9 if nothing.

    ``shown`` has (query_id, vector); both are bounded by the slates of a query.
    """
    was = shown.select(F.col("query_id").alias("__q"), F.col("vector").alias("__v"))
    pairs = pool.join(was, F.col("query_id") == F.col("__q"), "left")
    alike = F.round(F.max(dot(F.col("vector"), F.col("__v"))), 6)
    return pairs.groupBy("query_id", "doc_id", "rank").agg(F.first("vector").alias("vector"), F.coalesce(alike, F.lit(-1e9)).alias("repel"))


def ranked_subset(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (query_id, pos, doc_id) by similarity to their query (query_id, q); those without a vector (doc_id, v) follow in order."""
    known = candidates.join(vectors, "doc_id", "left").join(queries, "query_id", "left")
    score = F.round(dot(F.col("v"), F.col("q")), 6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "pos"))
    return known.withColumn("score", score).select("query_id", "doc_id", "pos", rank.alias("rank"))


def expanded(terms: DataFrame, more: DataFrame) -> DataFrame:
    return terms.unionByName(more.select("query_id", "term")).distinct()


def union_of_legs(legs: list[DataFrame]) -> DataFrame:
    """(query_id, doc_id, leg, rank): legs in order, as one table."""
    out = None
    for k, leg in enumerate(legs):
        part = leg.select("query_id", "doc_id", F.lit(k).alias("leg"), F.col("rank").cast("int").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def popularity(legs: DataFrame, popular: DataFrame) -> DataFrame:
    """The documents of all legs by popularity; equals in the order in which the legs first list them."""
    seen = legs.groupBy("query_id", "doc_id").agg(F.min(F.struct("leg", "rank")).alias("at"))
    scored = seen.join(popular, "doc_id", "left").withColumn("score", F.coalesce(F.col("popularity").cast("double"), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "doc_id"))
    return scored.select("query_id", "doc_id", rank.alias("rank"), "score")


def fused(legs: DataFrame, weights: DataFrame | list[float], n: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal-rank fusion; ties keep the order in which the legs first list a document.

    ``weights``: one number a leg, or a table (leg, weight and any further keys, such as a setting).
    """
    if isinstance(weights, list):
        pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("leg") + 1)
        weighed = legs.withColumn("weight", pick)
    else:
        weighed = legs.join(F.broadcast(weights), "leg")  # a table of settings: rows by legs and grid points
    weighed = weighed.where(F.col("weight") > 0)
    score = F.round(F.sum(F.col("weight") / (vocab.RRF_K + F.col("rank"))), 9)
    total = weighed.groupBy(*keys, "doc_id").agg(score.alias("score"), F.min(F.struct("leg", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "at", "doc_id"))
    out = total.select(*keys, "doc_id", rank.alias("rank"), "score")
    return out.where(F.col("rank") <= n) if n else out


def boosted(ranked: DataFrame, boost: Column) -> DataFrame:
    """Ranked rows moved by a boost; equals keep their order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boost"), "before"))
    return ranked.withColumnRenamed("rank", "before").withColumn("boost", boost).withColumn("rank", rank)


def match_points(stated: Column, value: Column) -> Column:
    """+1 for a match, -1 for a mismatch, 0 where either is unknown."""
    return F.when(stated.isNull() | value.isNull(), 0).when(stated == value, 1).otherwise(-1)


def reranked(ranked: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], depth: int = 20, weight: float = 3.0) -> DataFrame:
    """The first ``depth`` rows fused with their order by ``scorer`` (query text, document text); the tail follows.

    ``ranked`` has query_id, doc_id, rank, query and document.  Scoring is an Arrow-batched function
    of pairs, so any model can be injected; a null score or an exception (a failed model) leaves the
    order of its query unchanged.
    """

    def safe(query: pd.Series, document: pd.Series) -> pd.Series:
        try:
            return scorer(query, document)
        except Exception:
            return pd.Series([None] * len(query), dtype=float)

    score = F.pandas_udf(safe, "double")
    head = ranked.where(F.col("rank") <= depth).withColumn("model", score("query", "document"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("model"), "rank"))
    failed = F.max(F.col("model").isNull()).over(Window.partitionBy("query_id"))
    both = head.withColumn("again", F.when(failed, F.col("rank")).otherwise(again))
    value = F.round(1.0 / (vocab.RRF_K + F.col("rank")) + weight / (vocab.RRF_K + F.col("again")), 9)
    head = both.select("query_id", "doc_id", "rank", value.alias("value"))
    tail = ranked.where(F.col("rank") > depth).select("query_id", "doc_id", "rank", F.lit(None).cast("double").alias("value"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("value"), "rank"))
    return head.unionByName(tail).select("query_id", "doc_id", final.alias("rank"))


def reranked_grid(ranked: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], grid: DataFrame, deepest: int) -> DataFrame:
    """(setting, query_id, doc_id, rank) of ``reranked`` for a short table of settings (setting, weight, depth); pairs are scored once."""
    head = ranked.where(F.col("rank") <= deepest).withColumn("model", F.pandas_udf(scorer, "double")("query", "document"))
    rows = head.select("query_id", "doc_id", "rank", "model").unionByName(ranked.where(F.col("rank") > deepest).select("query_id", "doc_id", "rank", F.lit(None).cast("double").alias("model")))
    each = rows.crossJoin(F.broadcast(grid))  # a fixed list of settings
    inside = F.col("rank") <= F.col("depth")
    again = F.row_number().over(Window.partitionBy("setting", "query_id", inside).orderBy(F.desc_nulls_last("model"), "rank"))
    value = F.when(inside, F.round(1.0 / (vocab.RRF_K + F.col("rank")) + F.col("weight") / (vocab.RRF_K + F.col("again")), 9))
    final = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc_nulls_last("value"), "rank"))
    return each.withColumn("again", again).withColumn("value", value).select("setting", "query_id", "doc_id", final.alias("rank"))


def diversified(pool: DataFrame, k: int, trade: float, window: int = 40, pinned: int = 3, within: bool = True) -> DataFrame:
    """Greedy maximal marginal relevance on (query_id, doc_id, rank, vector, repel).

    Only the first ``window`` rows of a query are gathered; the rest follow in their order, untouched.
    Relevance is 1 / rank.  The first ``pinned`` stay; then whatever has the best trade of relevance
    against likeness to what is chosen (if ``within``) and to what was shown (``repel``), up to ``k``.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        if rows["pool"].iloc[0] > k:
            size = len(rows)
            v = np.stack(rows["vector"].to_numpy()[:size]).astype(float)
            alike = np.round(v @ v.T, 6)
            repel = rows["repel"].to_numpy(float)[:size]
            relevance = 1.0 / (np.arange(size) + 1)
            chosen = list(range(min(pinned, k, size)))
            while len(chosen) < min(k, size):
                rest = [i for i in range(size) if i not in chosen]
                cost = [max([repel[i], *(alike[i, chosen] if within else [])]) for i in rest]
                gain = np.round([trade * relevance[i] - (1 - trade) * c for i, c in zip(rest, cost)], 9)
                chosen.append(rest[int(np.argmax(gain))])
            rows = rows.loc[chosen + [i for i in range(len(rows)) if i not in chosen]].reset_index(drop=True)
        rows["rank"] = range(1, len(rows) + 1)
        return rows[["query_id", "doc_id", "rank"]]

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    placed = pool.withColumn("place", place).withColumn("pool", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    head = placed.where(F.col("place") <= window).groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, rank int")
    return head.unionByName(placed.where(F.col("place") > window).select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), F.col("place").alias("rank")))


def slate(pool: DataFrame, shown: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """The first ``k`` rows not shown before, filled up with shown ones in pool order; ``fresh`` says which."""
    seen = shown.select("query_id", "doc_id").distinct().withColumn("was", F.lit(True))
    marked = pool.join(seen, ["query_id", "doc_id"], "left").withColumn("fresh", F.col("was").isNull()).drop("was")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fresh"), "rank"))
    return marked.withColumn("place", place).where(F.col("place") <= k)


def answers(raw: DataFrame, catalog: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """Cleaned answers: (query_id, ids array) become the first ``k`` distinct, trimmed ids of the catalog, in order."""
    each = raw.select("query_id", F.posexplode("ids").alias("pos", "id")).withColumn("id", F.trim(F.col("id").cast("string")))
    known = each.where(F.col("id") != "").join(catalog.select(F.col("id")).distinct(), "id", "left_semi")
    first = known.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return top_n(first, k, F.col("pos"))
