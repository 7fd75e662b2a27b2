"""Ranks within groups that may be very large.

A plain row_number over a group puts the whole group into one task.  Here each group is cut into
ranges at quantiles of its ordering value; rows are ranked within (group, range) and the counts of
earlier ranges are added, so one dataset may hold a third of all rows, wherever its values lie.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import cut

RANGES = 64


def _same(groups: list[str], keys: list[str]) -> Column:
    return reduce(and_, (F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)))


def _ranged(x: DataFrame, groups: list[str], ranges: int) -> DataFrame:
    """Add ``_pf_range`` by the group's quantiles of ``_pf_order``; nulls get the last.

    The quantiles are sketched with partial aggregation, one short array a group, and written out, so that every use sees the same.
    """
    keys = [f"_pf_g{i}" for i in range(len(groups))]
    at = [i / ranges for i in range(1, ranges)]
    bounds = x.groupBy(*groups).agg(F.array_distinct(F.percentile_approx("_pf_order", at, 4 * ranges)).alias("_pf_bounds"))
    bounds = cut(bounds.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), "_pf_bounds"), "bounds")
    below = F.size(F.filter("_pf_bounds", lambda b: b < F.col("_pf_order")))
    part = F.when(F.col("_pf_order").isNull(), ranges).otherwise(below)
    return x.join(bounds, _same(groups, keys)).withColumn("_pf_range", part).drop(*keys, "_pf_bounds")


def _offsets(x: DataFrame, groups: list[str], count: Column) -> DataFrame:
    """(keys, _pf_r, _pf_before, _pf_size): how many rows of the group stand in earlier ranges, and in all."""
    keys = [f"_pf_g{i}" for i in range(len(groups))]
    counts = x.groupBy(*groups, "_pf_range").agg(count.alias("_pf_n"))
    before = Window.partitionBy(*groups).orderBy("_pf_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col("_pf_range").alias("_pf_r"), F.coalesce(F.sum("_pf_n").over(before), F.lit(0)).alias("_pf_before"), F.sum("_pf_n").over(Window.partitionBy(*groups)).alias("_pf_size"))


def rank_within(df: DataFrame, groups: list[str], order: Column | str, ties: list[str], out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Add ``out``, counted from 1, by ``order`` (a number, not null) and ``ties`` within ``groups``.

    Rows with a null order come last; groups that are null form a group.  Rows with one and the same order share a range.
    """
    if not groups:
        raise ValueError("name at least one group column")
    value = F.col(order) if isinstance(order, str) else order
    x = _ranged(df.withColumn("_pf_order", value.cast("double")), groups, ranges)
    keys = [f"_pf_g{i}" for i in range(len(groups))]
    counts = _offsets(x, groups, F.count("*"))
    local = F.row_number().over(Window.partitionBy(*groups, "_pf_range").orderBy(F.col("_pf_order").asc_nulls_last(), *ties))
    x = x.withColumn("_pf_local", local).join(counts, (F.col("_pf_range") == F.col("_pf_r")) & _same(groups, keys))
    return x.withColumn(out, F.col("_pf_before") + F.col("_pf_local")).drop("_pf_order", "_pf_range", "_pf_r", "_pf_before", "_pf_size", "_pf_local", *keys)


def exact_median(df: DataFrame, groups: list[str], value: str, out: str = "median") -> DataFrame:
    """(groups, ``out``): the interpolated median of each group, by ranks, so no group's values are gathered.  Nulls are left out.

    Equal values are counted before they are ranked, so a value that fills a group is one row.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_pf_order")).agg(F.count("*").alias("_pf_k"))
    x = _ranged(rows, groups, RANGES)
    keys = [f"_pf_g{i}" for i in range(len(groups))]
    within = Window.partitionBy(*groups, "_pf_range").orderBy("_pf_order").rowsBetween(Window.unboundedPreceding, 0)
    upto = x.withColumn("_pf_last", F.sum("_pf_k").over(within)).join(_offsets(x, groups, F.sum("_pf_k")), (F.col("_pf_range") == F.col("_pf_r")) & _same(groups, keys)).drop(*keys)
    upto = upto.withColumn("_pf_last", F.col("_pf_before") + F.col("_pf_last")).withColumn("_pf_first", F.col("_pf_last") - F.col("_pf_k") + 1)
    # the places in the middle, from 1: one of an odd number, two of an even one
    low, high = F.floor((F.col("_pf_size") + 1) / 2), F.floor((F.col("_pf_size") + 2) / 2)
    holds = lambda p: ((F.col("_pf_first") <= p) & (p <= F.col("_pf_last"))).cast("int")
    return upto.groupBy(*groups).agg((F.sum(F.col("_pf_order") * (holds(low) + holds(high))) / 2).alias(out))
