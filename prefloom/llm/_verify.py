"""Exact likeness of candidate pairs.

Joining a set to every pair it is in would shuffle it once a pair.  Here nodes fall by hash into as many lines as columns; a
pair belongs to the cell where its two nodes cross, and a node's content is sent once to each cell that needs it.  So
content travels at most ``2 * side`` times however many candidates a node has, a dense group of candidates is spread over all
cells, and cells grow in number with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of content that one task should hold.
TASK_BYTES = 48 << 20


def parts_for(size: int, least: int) -> int:
    """Partitions for ``size`` bytes, at least ``least``."""
    return max(least, -(-size // TASK_BYTES))


def grid(pairs: DataFrame, content: DataFrame, parts: int) -> DataFrame:
    """(a, b, content columns): a pair is a row without content, a node (in ``a``) a row without ``b``; each partition holds whole cells.

    ``pairs`` has a and b, ``content`` a column node and any others, one row a node.
    """
    side = max(1, isqrt(parts))
    rest = [f for f in content.schema if f.name != "node"]
    line, column = F.pmod(F.xxhash64("a"), F.lit(side)), F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side))
    placed = pairs.select((line * side + column).cast("int").alias("cell"), "a", "b")
    needed = placed.select("cell", F.col("a").alias("node")).union(placed.select("cell", F.col("b").alias("node"))).distinct()
    sent = needed.join(content, "node").select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), *(f.name for f in rest))
    bare = placed.select("cell", "a", "b", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    return sent.union(bare).repartitionById(side * side, "cell").drop("cell")


def gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
    """Pairs (two arrays) and the batches of nodes of one partition of ``grid``."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    nodes = []
    for batch in batches:
        bare = batch.column(1).is_valid()
        both = batch.filter(bare)
        left.append(both.column(0).to_numpy(zero_copy_only=False))
        right.append(both.column(1).to_numpy(zero_copy_only=False))
        rest = batch.filter(pc.invert(bare))
        if rest.num_rows:
            nodes.append(rest)
    return np.concatenate(left), np.concatenate(right), nodes


def common(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of groups (numbers) how many values both have; ``values`` are distinct within a group."""
    out = np.zeros(len(left), np.int64)
    if not len(left):
        return out
    _, number = np.unique(values, return_inverse=True)
    mark = np.zeros(int(number.max()) + 1 if len(number) else 1, np.int64)
    size = np.diff(first)
    order = np.argsort(left, kind="stable")
    edge = np.concatenate(([0], np.flatnonzero(np.diff(left[order])) + 1, [len(order)]))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        mine = number[first[left[order[s]]] : first[left[order[s]] + 1]]
        mark[mine] = 1
        at = s
        while at < e:  # a bounded number of values at once
            others = right[order[at:e]]
            ends = np.cumsum(size[others])
            take = max(1, int(np.searchsorted(ends, 2_000_000)))
            others, ends = others[:take], ends[:take]
            total = int(ends[-1])
            where = np.repeat(first[others] - (ends - size[others]), size[others]) + np.arange(total)
            hits = np.concatenate(([0], np.cumsum(mark[number[where]])))
            out[order[at : at + take]] = hits[ends] - hits[ends - size[others]]
            at += take
        mark[mine] = 0
    return out


def likeness(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared values over all values of each pair of groups; 0 for two empty groups."""
    size = np.diff(first)
    both = common(values, first, left, right)
    return both / np.maximum(1, size[left] + size[right] - both)
