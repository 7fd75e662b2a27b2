"""Problem 2: a subset of given size that covers the variety of the data.

Method: distributed farthest-first k-center.  Every block of rows (by a hash of their ids) selects its own representatives
greedily, representatives are pooled a few blocks at a time, and farthest-first runs again on each
pool until one is left.  Greedy selections are prefixes of each other, so requests over the same rows share one
run.  A prompt's point has a part for the tasks' seed words, weighted by their rarity, and a part for all its
words; similar prompts lie together and give one representative before any of them gives a second.  While
seed words are uncovered, a row's distance to the rows chosen is lengthened by the weights of those it would
cover, so rare ones are met early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.operators.ordered import rank_within
from prefloom.session import arrow_map, cut, ship

SEED_DIMS, WORD_DIMS = 64, 32
#: How much an uncovered seed word adds to a squared distance, as a multiple of its squared weight.
COVER = 4.0
#: Rows a block holds on average, and blocks that are pooled at once.
BLOCK, FAN_IN = 16_384, 16
#: Seed words beyond which the task tables are no small side tables any more.
MAX_SEEDS = 1_000_000


def _signs(hashes: np.ndarray, dims: int, salt: int) -> np.ndarray:
    """Pseudo-random directions of words: dims entries of 1 or -1."""
    h = W.mix(hashes + np.uint64(salt))
    bits = (h[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.float32) * 2 - 1


def points(texts: list[str | None], seeds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A point for each text and the numbers of its seed words; ``seeds`` are sorted word hashes with their ``weights``."""
    out = np.zeros((len(texts), SEED_DIMS + WORD_DIMS), dtype=np.float32)
    held = [np.zeros(0, np.int32)] * len(texts)
    for s in W.chunks([texts]):
        w = W.words(texts[s])
        owner = w.owner()
        n = len(w.first) - 1
        if not len(w.hashes):
            continue
        key = np.unique(np.stack([owner.astype(np.uint64), w.hashes], axis=1), axis=0)
        who, word = key[:, 0].astype(np.int64), key[:, 1]
        first = np.searchsorted(who, np.arange(n))
        some = np.diff(np.append(first, len(who))) > 0
        if len(seeds):
            at = np.minimum(np.searchsorted(seeds, word), len(seeds) - 1)
            hit = seeds[at] == word
            weight = np.where(hit, weights[at], 0).astype(np.float32)
            edges = np.searchsorted(who[hit], np.arange(n + 1))
            numbers = at[hit].astype(np.int32)
            for i in range(n):
                held[s.start + i] = numbers[edges[i] : edges[i + 1]]
            # each seed word moves the point by its weight
            part = _signs(word, SEED_DIMS, 1) * (weight / np.sqrt(SEED_DIMS))[:, None]
            out[s.start + np.flatnonzero(some), :SEED_DIMS] = np.add.reduceat(part, first[some])
        part = np.add.reduceat(_signs(word, WORD_DIMS, 2), first[some])
        out[s.start + np.flatnonzero(some), SEED_DIMS:] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-6)
    return out, held


def farthest_first(ids: np.ndarray, x: np.ndarray, k: int, held: list[np.ndarray] | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``k`` rows in the order chosen, and each one's distance to those before; ties go to the lesser id.

    ``held`` are the seed words of each row and ``weights`` what they weigh.
    """
    order = np.argsort(ids, kind="stable")
    order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))] if len(ids) else order
    y = np.ascontiguousarray(x[order])
    n = len(order)
    k = min(k, n)
    norm = np.einsum("ij,ij->i", y, y)
    picked = np.zeros(k, dtype=np.int64)
    far = np.zeros(k)
    nearest = np.full(n, np.inf, dtype=np.float32)
    bonus = np.zeros(n, dtype=np.float32)
    mine = [held[j] for j in order] if held is not None else []
    if mine and weights is not None and len(weights):
        worth = (COVER * weights * weights).astype(np.float32)
        row = np.repeat(np.arange(n), [len(m) for m in mine])
        number = np.concatenate(mine).astype(np.int64)
        np.add.at(bonus, row, worth[number])
        by = np.argsort(number, kind="stable")
        row, first = row[by], np.searchsorted(number[by], np.arange(len(worth) + 1))
        open_ = np.ones(len(worth), dtype=bool)
    else:
        mine = []
    at = int((norm + bonus).argmax()) if n else 0
    for i in range(k):
        picked[i] = at
        far[i] = np.sqrt(max(0.0, float(nearest[at]))) if i else float("inf")
        # rounded, so that equal points stay equal whatever block they are computed in
        d = np.round(np.maximum(norm + norm[at] - 2 * (y @ y[at]), 0), 4)
        np.minimum(nearest, d, out=nearest)
        nearest[at] = -1e9
        if mine:
            for w in mine[at].tolist():
                if open_[w]:
                    open_[w] = False
                    bonus[row[first[w] : first[w + 1]]] -= worth[w]
        at = int((nearest + np.round(bonus, 4)).argmax())
    return order[picked], far


def _select(batches: Iterator[pa.RecordBatch], seeds: np.ndarray, weights: np.ndarray, sizes: dict) -> Iterator[pa.RecordBatch]:
    """(id, dataset, text) of one block to its representatives, for each wanted dataset and for all (null).

    The whole block is at hand before anything is chosen, so the order in which its rows arrive decides nothing.
    """
    ids, sets, x, words = [], [], [], []
    for batch in batches:
        if batch.num_rows:
            ids.append(np.asarray(batch.column(0).to_numpy(zero_copy_only=False)))
            sets += batch.column(1).to_pylist()
            p, w = points(batch.column(2).to_pylist(), seeds, weights)
            x.append(p)
            words += w
    if not ids:
        return
    ids, x, sets = np.concatenate(ids), np.concatenate(x), np.array(sets, dtype=object)
    for g, k in sizes.items():
        sel = np.arange(len(ids)) if g is None else np.flatnonzero(sets == g)
        at, _ = farthest_first(ids[sel], x[sel], k, [words[i] for i in sel], weights)
        at = sel[at]
        columns = [pa.array([g] * len(at), pa.int64()), pa.array(ids[at]), pa.array([x[i].tobytes() for i in at], pa.binary()), pa.array([words[i].tobytes() for i in at], pa.binary())]
        yield pa.record_batch(columns, ["grp", "id", "point", "words"])


def _count_seeds(batches: Iterator[pa.RecordBatch], seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(seeds), np.int64)
    rows = 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        rows += len(texts)
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            at = np.minimum(np.searchsorted(seeds, w.hashes), max(0, len(seeds) - 1))
            hit = seeds[at] == w.hashes if len(seeds) else np.zeros(len(w.hashes), bool)
            both = np.unique(np.stack([w.owner()[hit], at[hit]], axis=1), axis=0)
            total += np.bincount(both[:, 1].astype(np.int64), minlength=len(seeds))
    yield pa.record_batch([pa.array(np.append(np.arange(len(seeds)), -1)), pa.array(np.append(total, rows))], ["seed", "n"])


def _merge(pdf: pd.DataFrame, sizes: dict, weights: np.ndarray) -> pd.DataFrame:
    g = pdf["grp"].iloc[0]
    k = sizes[None if pd.isna(g) else int(g)]
    x = np.stack([np.frombuffer(b, np.float32) for b in pdf["point"]])
    at, far = farthest_first(pdf["id"].to_numpy(), x, k, [np.frombuffer(b, np.int32) for b in pdf["words"]], weights)
    out = pdf.iloc[at].copy()
    out["place"] = np.arange(1, len(at) + 1)
    out["distance"] = far
    return out


def varied_subsets(
    rows: DataFrame, requests: DataFrame, tasks: DataFrame, id_col: str = "sample_id", text_col: str = "prompt", group_col: str = "dataset_idx"
) -> DataFrame:
    """For each request (request_id, ``group_col``, subset_size) the chosen rows.

    Returns (request_id, place, ``id_col``, distance): place counts from 1 in the order chosen, distance is that to the nearest
    row chosen before (null for the first).  A null group means all rows; a size that isn't below the number of rows means all of
    them, without a selection: in order of id, with a null distance.  A null or non-positive size means none.  The result
    doesn't depend on how the rows are partitioned.  Repeated ids count once, null ids are dropped, a null text is a point without
    words.  Unknown groups and empty tables give no rows.
    """
    spark = rows.sparkSession
    wanted = [(r[0], r[1], r[2]) for r in requests.select("request_id", group_col, "subset_size").collect() if r[2] and r[2] > 0]
    picked = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(text_col).alias("t"))
    kind = rows.schema[id_col].dataType.simpleString()
    # rows of each wanted group; one number each
    one = picked.select("id", "g").dropDuplicates(["id"])
    have = {r[0]: r[1] for r in one.where(F.col("g").isin([g for _, g, _ in wanted if g is not None])).groupBy("g").count().collect()}
    have[None] = one.count()
    whole = [(i, g) for i, g, k in wanted if k >= have.get(g, 0)]
    every = None
    for i, g in whole:
        part = one if g is None else one.where(F.col("g") == g)
        part = rank_within(part.select(F.lit(i).alias("request_id"), "id", F.xxhash64("id").alias("h")), ["request_id"], F.col("id") if kind in ("int", "bigint") else F.col("h"), ["id"], "place")
        part = part.select("request_id", F.col("place").cast("int"), F.col("id").alias(id_col), F.lit(None).cast("double").alias("distance"))
        every = part if every is None else every.unionByName(part)
    asked_for_all = {i for i, _ in whole}
    sizes: dict = {}
    for i, g, k in wanted:
        if i not in asked_for_all:
            sizes[g] = max(k, sizes.get(g, 0))
    if every is None:
        every = spark.createDataFrame([], f"request_id int, place int, {id_col} {kind}, distance double")
    if not sizes:
        return every
    words = [r[0] for r in tasks.select(F.explode(F.map_values("domain")).alias("c")).select(F.explode("c.seed_words").alias("w")).where("w is not null").distinct().limit(MAX_SEEDS + 1).collect()]
    if len(words) > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} seed words")
    seeds = np.unique(W.words(words).hashes) if words else np.zeros(0, np.uint64)
    counts = {r[0]: r[1] for r in arrow_map(rows.select(text_col), lambda it: _count_seeds(it, seeds), "seed long, n long").groupBy("seed").agg(F.sum("n")).collect()}
    total = max(1, counts.get(-1, 0))
    weights = np.array([np.log((total + 1) / (counts.get(i, 0) + 1)) + 0.5 for i in range(len(seeds))], dtype=np.float32) / np.log(total + 2)
    if not any(g is None for g in sizes):
        picked = picked.where(F.col("g").isin(list(sizes)))
    blocks = max(1, -(-(have[None] if None in sizes else sum(have[g] for g in sizes)) // BLOCK))
    picked = picked.repartitionById(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    chosen = arrow_map(picked, lambda it: _select(it, seeds, weights, sizes), f"grp long, id {kind}, point binary, words binary").withColumn("block", F.spark_partition_id())
    chosen = cut(chosen, "representatives")
    ship(spark)
    schema = f"grp long, id {kind}, point binary, words binary, block int, place int, distance double"
    while True:
        blocks = -(-blocks // FAN_IN)
        pooled = chosen.select("grp", "id", "point", "words", (F.col("block") / FAN_IN).cast("int").alias("block"))
        chosen = cut(pooled.groupBy("grp", "block").applyInPandas(lambda pdf: _merge(pdf, sizes, weights), schema), "pool")
        if blocks == 1:
            break
    asked = spark.createDataFrame([(i, g, k) for i, g, k in wanted if i not in asked_for_all], "request_id int, g long, size int")
    selected = (
        chosen.join(F.broadcast(asked), F.col("grp").eqNullSafe(F.col("g")) & (F.col("place") <= F.col("size")))
        .select("request_id", "place", F.col("id").alias(id_col), F.when(F.col("place") > 1, F.round("distance", 3)).alias("distance"))
    )
    return selected.unionByName(every)
