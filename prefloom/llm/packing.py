"""Problem 7: texts of varying length into containers of fixed capacity.

Method: pattern packing by non-negative least squares.  Only the histogram of lengths (at most
``capacity`` numbers) reaches the driver.  There, patterns of a few lengths that fill a container are enumerated,
repeat counts are fitted to the histogram by non-negative least squares, rounded, and what is left
is packed exactly, again on the histogram.  Texts then take their places by their rank within
their length, computed in salted pieces so that a length shared by very many texts isn't one task's work.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import arrow_map, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Patterns enumerated for one capacity, sweeps of the least-squares solver.
MAX_PATTERNS, SWEEPS = 8000, 60

_encoders: dict = {}


def _encoder(ranks_file: bytes):
    """One encoder for each worker process."""
    key = hashlib.blake2b(ranks_file).digest()
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _tokens(batches: Iterator[pa.RecordBatch], ranks_file: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encode = _encoder(ranks_file).encode_ordinary
        sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["id", "tokens"])


def token_counts(rows: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``id_col``, tokens); the vocabulary file (of fixed size) travels with the job, workers need no copy."""
    with open(tokenizer, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())
    picked = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = arrow_map(picked, lambda it: _tokens(it, ranks.value), f"id {kind}, tokens long")
    return out.dropDuplicates(["id"]).withColumnRenamed("id", id_col)


def enumerate_patterns(have: np.ndarray, capacity: int, limit: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of one to four present lengths that fill the capacity, or nearly where nothing fills it."""
    lengths = np.flatnonzero(have[: capacity + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    present = have[: capacity + 1] > 0
    below = np.maximum.accumulate(np.where(present, np.arange(capacity + 1), 0))  # greatest present length up to i
    out: dict[tuple[int, ...], None] = {}
    if present[capacity]:
        out[(capacity,)] = None
    for a in lengths[::-1]:
        b = int(below[capacity - a])
        if b and capacity - a - b <= capacity // 64:
            out[tuple(sorted((int(a), b), reverse=True))] = None
    # frequent lengths, spread over the whole range, as middle members
    share = max(1, min(len(lengths), (limit - len(out)) // max(1, 2 * len(lengths))))
    mass = np.cumsum(have[lengths])
    middle = np.unique(lengths[np.minimum(np.searchsorted(mass, (np.arange(share) + 0.5) / share * mass[-1]), len(lengths) - 1)])
    for m in middle:
        for a in lengths[::-1]:
            rest = capacity - int(a) - int(m)
            if rest > 0 and below[rest] and rest - below[rest] <= capacity // 256:
                out[tuple(sorted((int(a), int(m), int(below[rest])), reverse=True))] = None
            half = rest // 2
            if half > 0 and below[half]:
                c = int(below[half])
                d = int(below[rest - c])
                if d and rest - c - d <= capacity // 256:
                    out[tuple(sorted((int(a), int(m), c, d), reverse=True))] = None
            if len(out) >= limit:
                return list(out)
    return list(out)


def non_negative_fit(patterns: list[tuple[int, ...]], have: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - have||, by cyclic coordinate descent on the sparse columns."""
    columns = [list(Counter(p).items()) for p in patterns]
    squares = [sum(m * m for _, m in c) for c in columns]
    rest = have.astype(np.float64).tolist()
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(m * rest[n] for n, m in c) / squares[j]
            new = max(0.0, x[j] + step)
            step = new - x[j]
            if step:
                x[j] = new
                for n, m in c:
                    rest[n] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def fill_exactly(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram: the longest item first, then the one, two or three lengths that fill the rest best."""
    out: list[tuple[tuple[int, ...], int]] = []
    left = left.copy()
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        items = [longest]
        left[longest] -= 1
        space = capacity - longest
        while space:
            up = np.flatnonzero(left[: space + 1])
            up = up[up > 0]
            if not len(up):
                break
            one = int(up[-1])
            if one == space:
                take = [one]
            else:
                # two lengths a >= b with a + b as close to the space as possible
                take = [one]
                best = space - one
                second = np.searchsorted(up, space - up, "right") - 1
                ok = second >= 0
                a, b = up[ok], up[second[ok]]
                same = (a == b) & (left[a] < 2)
                gap = np.where(same, best, space - a - b)
                if len(gap) and gap.min() < best:
                    k = int(gap.argmin())
                    take = [int(a[k]), int(b[k])]
                elif space > 3 * int(up[0]):
                    take = [int(up[len(up) // 2])] if int(up[len(up) // 2]) * 3 <= space else [one]
            for t in take:
                left[t] -= 1
                space -= t
            items += take
        # the same container again as often as all its lengths last
        need = Counter(items)
        more = min(int(left[n]) // m for n, m in need.items())
        for n, m in need.items():
            left[n] -= m * more
        out.append((tuple(sorted(items, reverse=True)), 1 + more))


def plan(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold exactly the histogram ``have`` (index: length up to capacity)."""
    have = have.astype(np.int64)
    patterns = enumerate_patterns(have, capacity)
    fitted = non_negative_fit(patterns, have)
    left = have.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    # fullest patterns first, so that rounding never spends a length on a worse pattern
    order = sorted(range(len(patterns)), key=lambda j: (capacity - sum(patterns[j]), -fitted[j]))
    for j in order:
        need = Counter(patterns[j])
        n = min(int(round(fitted[j])), *(int(left[k]) // m for k, m in need.items()))
        if n > 0:
            for k, m in need.items():
                left[k] -= n * m
            out.append((patterns[j], n))
    return out + fill_exactly(left, capacity)


def _places(packs: dict[int, list]) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """For each (pack, length): first ranks, container bases and multiplicities of its pattern slots."""
    out: dict[tuple[int, int], list] = {}
    for pack, patterns in packs.items():
        base = 1
        used: Counter = Counter()
        for pattern, n in patterns:
            for length, m in Counter(pattern).items():
                out.setdefault((pack, length), []).append((used[length], base, m))
                used[length] += n * m
            base += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def _assign(batches: Iterator[pa.RecordBatch], places: dict) -> Iterator[pa.RecordBatch]:
    """(pack, length, rank, ...) to its container."""
    for batch in batches:
        pack, length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        container = np.zeros(len(pack), dtype=np.int64)
        key = pack * (1 << 32) + length
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order], prepend=-1))
        for s, e in zip(edges, np.append(edges[1:], len(order)), strict=True):
            at = order[s:e]
            first, base, m = places[(int(pack[at[0]]), int(length[at[0]]))]
            k = np.searchsorted(first, rank[at], "right") - 1
            container[at] = base[k] + (rank[at] - first[k]) // m[k]
        yield pa.record_batch([batch.column(0), pa.array(container), batch.column(3), batch.column(4), batch.column(1)], ["pack_id", "container_id", "id", "piece", "tokens"])


def pack(sizes: DataFrame, packs: DataFrame, id_col: str, salts: int | None = None) -> DataFrame:
    """Place every text of ``sizes`` (``id_col``, tokens) for every row of ``packs`` (pack_id, capacity_tokens).

    Returns (pack_id, container_id, ``id_col``, piece, tokens).  A text longer than a container is cut into full pieces and a
    rest (pieces count from 1); no other text is split.  Texts without tokens take no place and have no row; packs with a null
    or non-positive capacity have none either.  Empty tables give an empty result.
    """
    spark = sizes.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    caps = {r[0]: r[1] for r in packs.select("pack_id", "capacity_tokens").collect() if r[0] is not None and r[1] and r[1] > 0}
    kind = sizes.schema[id_col].dataType.simpleString()
    if not caps:
        return spark.createDataFrame([], f"pack_id int, container_id long, {id_col} {kind}, piece int, tokens long")
    # every text once for each of the few packs
    every = F.explode(F.array(*(F.struct(F.lit(int(i)).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, c in caps.items())))
    pieces = (
        sizes.where("tokens > 0")
        .select(id_col, "tokens", every.alias("p"))
        .select(id_col, "tokens", "p.pack_id", "p.capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))))
        .select("pack_id", F.col(id_col).alias("id"), "piece", F.least(F.col("capacity"), F.col("tokens") - (F.col("piece") - 1) * F.col("capacity")).alias("length"))
        .withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    )
    pieces = cut(pieces, "pieces")
    counts = cut(pieces.groupBy("pack_id", "length", "salt").agg(F.count("*").alias("n")), "counts")
    by = Window.partitionBy("pack_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_id", "length", "salt", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    histogram: dict[int, np.ndarray] = {int(i): np.zeros(int(c) + 1, dtype=np.int64) for i, c in caps.items()}
    for r in counts.groupBy("pack_id", "length").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[r[0]][r[1]] = r[2]
    places = _places({i: plan(histogram[int(i)], int(c)) for i, c in caps.items()})
    shared = spark.sparkContext.broadcast(places)
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("pack_id", "length", "salt").orderBy("id", "piece")))
    ranked = ranked.join(offsets, ["pack_id", "length", "salt"]).select("pack_id", "length", (F.col("before") + F.col("local") - 1).alias("rank"), "id", "piece")
    out = arrow_map(ranked, lambda it: _assign(it, shared.value), f"pack_id int, container_id long, id {kind}, piece int, tokens long")
    return out.withColumnRenamed("id", id_col)


def packing_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, unused tokens, share used, and the least number of containers that could do."""
    per = placed.groupBy("pack_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(F.broadcast(packs.select("pack_id", "capacity_tokens")), "pack_id").select(
        "pack_id", "containers", "tokens",
        (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"),
    )
