"""Connected components of an edge table, by contraction.

Cases: an edge of a node to itself and repeated edges add nothing; a null end is not an edge; a node
without any other stands in no edge and is not in the result; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b); root is the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself) and replaces the ends of every
    edge by where they point; edges within one node vanish.  Round k first doubles the pointers'
    reach k times, so stars take one or two cheap rounds and even long chains few.  Nothing is collected but whether edges remain.
    Pointers at a hub are many, but sums before the shuffle and adaptive skew joins spread them.
    """
    tidy = lambda lo, hi: edges_between(F.col(lo), F.col(hi))

    def edges_between(x, y):
        return F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")

    live = checkpointed(edges.select(*tidy("a", "b")).where("lo < hi").distinct())
    labels, doublings = None, 0
    while not live.isEmpty():
        near = live.select(F.col("hi").alias("v"), F.col("lo").alias("m")).unionByName(live.select(F.col("lo").alias("v"), F.col("lo").alias("m")))
        jump = near.groupBy("v").agg(F.min("m").alias("m"))
        for _ in range(doublings):
            there = jump.select(F.col("v").alias("__v"), F.col("m").alias("__m"))
            jump = jump.join(there, F.col("m") == F.col("__v")).select("v", F.col("__m").alias("m"))
        jump = checkpointed(jump)
        doublings += 1
        if labels is None:
            labels = jump.select(F.col("v").alias("node"), F.col("m").alias("root"))
        else:
            moved = labels.join(jump, labels["root"] == jump["v"], "left")
            labels = checkpointed(moved.select("node", F.coalesce("m", "root").alias("root")))
        low, high = (jump.select(F.col("v").alias(f"__{e}"), F.col("m").alias(f"m_{e}")) for e in ("lo", "hi"))
        moved = live.join(low, F.col("lo") == F.col("__lo")).join(high, F.col("hi") == F.col("__hi"))
        live = checkpointed(moved.where("m_lo <> m_hi").select(*tidy("m_lo", "m_hi")).distinct())
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return labels
