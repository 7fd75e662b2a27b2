"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.session import cut, drop


def _state(edges: DataFrame) -> tuple:
    x = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(x), F.sum(F.shiftright(x, 20))).first())


def _minimum(edges: DataFrame, keep: Column) -> DataFrame:
    """(u, v) with ``m``, the least of u and those neighbours for which ``keep`` holds."""
    least = edges.where(keep).groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame, left: str, right: str, rounds: int = 40) -> DataFrame:
    """Label each node of ``edges`` with the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round joins the
    edges with their own neighbourhood minima, which are partially aggregated before the
    shuffle, so a node with many neighbours never sits in one group.  Each round is cut and the one before it dropped.
    Returns (node, root); nodes without edges don't appear, nulls and loops are dropped.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both, F.lit(True)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every edge now runs from a node to a smaller one
        small = _minimum(large, F.lit(True))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.where("u <> v").distinct(), "edges")
        drop(last)
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
