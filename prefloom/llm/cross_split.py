"""Problem 1: the same or nearly the same record in two splits.

Method: winnowing.  Rolling hashes of ``GRAM`` words are thinned to the minima of windows of
``WINDOW`` positions, so any run of ``GRAM + WINDOW - 1`` words that two records share gives both
the same seed.  Seeds of the two splits are joined (packed into blobs and sorted with numpy); a
seed that is frequent on both sides is compared whole, train times test, in blocks of sketches that are spread over tasks.
Candidates pass a one-bit sketch of 384 bits; the exact likeness decides (``_verify``), and the seeds of the pairs that
remain are chained collinearly and extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.llm._lang import common_words
from prefloom.llm._verify import gather, grid, likeness, parts_for
from prefloom.session import arrow_map, cut, ship, small

THRESHOLD, GRAM, WINDOW = 0.6, 4, 12
#: Words of 64 bits in a record's sketch, and the bits of each 128 in which two sketches must agree on average: 281 of 384 (likeness 0.6:
#: about 307, deviation 7.8; likeness 0.25, as of records by the same phrases: 240, deviation 9.5, so false candidates stay few among
#: quadratically many records that share a phrase).  Pairs whose first 128 bits differ in over FIRST aren't compared further (0.6: about 26, deviation 4.5).
WORDS, AGREE, FIRST = 6, 93.5, 40
#: A run shared with a record of under SHORT word pairs may be too short for a window.  Such records, and all that may be like one of
#: them, also give word pairs as seeds: of any order of all word pairs, two records of likeness t share one among each one's first
#: n - ceil(t n) + 1 (prefix filter).  Pairs of two function words come last in the order, so they are hardly ever seeds.
SHORT = 80
#: Train rows times test rows of one seed up to which its pairs are enumerated at once, and up to which they are compared in the seed's own
#: task; the rows of other seeds are compared in blocks of SIDE by SIDE, each a group of its own.
EASY, HOT, SIDE = 4096, 1 << 20, 8192
#: Rows of a seed in one batch above which they go straight to those blocks, so that no task gathers a hot seed.
HOT_BATCH = 256
#: Rows of one side of a block that fits the processor's cache; pairs held at once, above which repeats are dropped.
CACHE, HELD_PAIRS = 512, 4_000_000
#: Bytes of seed rows for each character of text, as measured, for the number of partitions only.
SEED_BYTES = 1.6

ROW = np.dtype([("key", "<u4"), ("node", "<u8"), ("sketch", "<u8", WORDS)])
MEMBER = np.dtype([("part", "<i4"), ("key", "<u4"), ("node", "<u8"), ("sketch", "<u8", WORDS), ("train", "?")])
FOUND = "train long, test long, part int, key long, sketch binary"


def winnow(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Selected (word position, gram hash); windows stay within one text, a shorter text is one window."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pad = np.concatenate([w.hashes, np.zeros(GRAM, np.uint64)])
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for j in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + pad[j : j + n]
        gram = W.mix(gram) >> np.uint64(1)
    counts = w.counts
    grams = np.where(counts > 0, np.maximum(counts - GRAM + 1, 1), 0)
    owner = w.owner()
    place = np.arange(n) - w.first[:-1][owner]
    valid = place < grams[owner]
    short = np.flatnonzero((counts > 0) & (counts < GRAM))
    for i in short:  # a text shorter than a gram: one gram of all its words
        with np.errstate(over="ignore"):
            gram[w.first[i]] = W.mix(w.hashes[w.first[i] : w.first[i + 1]].sum(dtype=np.uint64) + np.uint64(counts[i])) >> np.uint64(1)
    top = np.uint64(0x7FFFFFFFFFFFFFFF)
    g = np.where(valid, gram, top)
    g = np.concatenate([g, np.full(WINDOW, top, np.uint64)])
    span, m = 1, g
    while span * 2 <= WINDOW:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < WINDOW:
        m = np.minimum(m[: len(m) - (WINDOW - span)], m[WINDOW - span :])
    m = m[:n].copy()
    m[place + WINDOW > grams[owner]] = 0  # windows stay within their text
    best = np.concatenate([np.zeros(WINDOW - 1, np.uint64), m])
    span = 1
    while span * 2 <= WINDOW:
        best = np.maximum(best[: len(best) - span], best[span:])
        span *= 2
    if span < WINDOW:
        best = np.maximum(best[: len(best) - (WINDOW - span)], best[WINDOW - span :])
    # a text with fewer grams than a window is one window
    lone = np.flatnonzero((grams > 0) & (grams < WINDOW))
    if len(lone):
        starts = w.first[:-1][lone]
        bounds = np.stack([starts, starts + grams[lone]], axis=1).ravel()
        least = np.minimum.reduceat(np.concatenate([g[:n], [top]]), bounds)[::2]
        best = best[:n].copy()
        best[np.isin(owner, lone)] = np.repeat(least, counts[lone])
    chosen = np.flatnonzero((best[:n] == gram) & valid)
    return chosen, gram[chosen]


def _records(columns: list[list[str | None]], s: slice) -> list[str | None]:
    """The fields of each record one after another."""
    return [t for row in zip(*(c[s] for c in columns), strict=True) for t in row]


def _rare_pairs(w: W.Words, pairs: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(record, pair) of the word pairs that a short record, or one that may be like a short one, gives as seeds."""
    value, at = np.unique(pairs, return_index=True)
    flags = np.isin(w.hashes, common_words())
    inner = np.ones(len(w.hashes), bool)
    inner[w.first[1:][w.counts > 0] - 1] = False  # the last word of a text begins no pair
    begins = np.flatnonzero(inner)
    flag = flags[begins[at]] & flags[begins[at] + 1]
    distinct, edges = W.distinct(pairs, first)
    size = np.diff(edges)
    few = np.flatnonzero((size > 0) & (size < SHORT / threshold))
    if not len(few):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    take = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in few])
    record, mine = np.repeat(few, size[few]), distinct[take]
    late = flag[np.searchsorted(value, mine)]
    order = np.lexsort((mine, late, record))
    record, mine = record[order], mine[order]
    rank = np.arange(len(record)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    keep = rank < size[record] - np.ceil(threshold * size[record] - 1e-9) + 1
    return record[keep], mine[keep]


def _seed_rows(w: W.Words, fields: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(record, key, record print, sketch) of all seeds of a chunk."""
    pairs, first = W.pairs_of(w)
    first = first[::fields]
    record_first = w.first[::fields]
    # borders between fields count for the print: mix the field number into the words
    owner = w.owner()
    node = W.order_print(W.mix(w.hashes + (owner % fields).astype(np.uint64)), record_first)
    sketch = W.long_sketch(pairs, first, WORDS)
    at, gram = winnow(w)
    record = owner[at] // fields
    if len(pairs):
        short, mine = _rare_pairs(w, pairs, first, threshold)
        record = np.concatenate([record, short])
        gram = np.concatenate([gram, W.mix(mine) >> np.uint64(1)])
    some = np.diff(first)[record] > 0
    return record[some], gram[some], node, sketch


def _blob_rows(out: list[tuple[int, bool | None, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.binary())],
        ["part", "train", "blob"],
    )


def _pack(batches: Iterator[pa.RecordBatch], parts: int, train: str, fields: int, threshold: float, hot_batch: int = HOT_BATCH) -> Iterator[pa.RecordBatch]:
    """Batches to blobs of seed rows, one for each target partition p and side.

    Part -1 holds members of seeds that are hot in their batch, ``parts + p`` the keys of those seeds.
    """
    for batch in batches:
        split = np.array([x == train for x in batch.column(0).to_pylist()])
        columns = [batch.column(i + 1).to_pylist() for i in range(fields)]
        held = []
        for s in W.chunks(columns):
            record, gram, node, sketch = _seed_rows(W.words(_records(columns, s)), fields, threshold)
            rows = np.empty(len(gram), dtype=[("full", "<u8"), ("node", "<u8"), ("sketch", "<u8", WORDS), ("train", "?")])
            rows["full"] = gram << np.uint64(1)
            rows["node"], rows["sketch"] = node[record], sketch[record]
            rows["train"] = split[s][record]
            held.append(rows)
        if not held:
            continue
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["node"], rows["train"], rows["full"]))]
        if len(rows):  # copies in a batch and repeats in a record count once
            again = np.zeros(len(rows), bool)
            again[1:] = (rows["full"][1:] == rows["full"][:-1]) & (rows["node"][1:] == rows["node"][:-1]) & (rows["train"][1:] == rows["train"][:-1])
            rows = rows[~again]
        part = ((rows["full"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        out: list[tuple[int, bool | None, bytes]] = []
        # by part and key, as a reducer sees them
        edge = np.concatenate(([0], np.flatnonzero(np.diff(rows["full"])) + 1, [len(rows)])) if len(rows) else np.zeros(1, np.int64)
        hot = np.repeat(np.diff(edge) > hot_batch, np.diff(edge))
        if hot.any():
            m = np.empty(int(hot.sum()), dtype=MEMBER)
            m["part"], m["key"], m["node"], m["sketch"], m["train"] = part[hot], rows["full"][hot].astype(np.uint32), rows["node"][hot], rows["sketch"][hot], rows["train"][hot]
            out.append((-1, None, m.tobytes()))
            told = np.unique(np.stack([m["part"].astype(np.int64), m["key"].astype(np.int64)], axis=1), axis=0)
            for p in np.unique(told[:, 0]).tolist():
                out.append((parts + p, None, told[told[:, 0] == p, 1].astype(np.uint32).tobytes()))
            rows, part = rows[~hot], part[~hot]
        edges = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = rows[edges[p] : edges[p + 1]]
            for side in (True, False):
                sel = mine[mine["train"] == side]
                if len(sel):
                    r = np.empty(len(sel), dtype=ROW)
                    r["key"] = sel["full"].astype(np.uint32)
                    r["node"], r["sketch"] = sel["node"], sel["sketch"]
                    out.append((p, side, r.tobytes()))
        yield _blob_rows(out)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of each 128 in which the sketches of two equally long arrays differ on average; 128 where the first 128 differ in over FIRST."""
    first = W.popcount(a[:, 0] ^ b[:, 0]) + W.popcount(a[:, 1] ^ b[:, 1])
    near = np.flatnonzero(first <= FIRST)
    out = np.full(len(a), 128.0)
    out[near] = W.popcount(a[near] ^ b[near]).sum(axis=1) * (2 / WORDS)
    return out


def _alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those places (i, j) at which the sketches ``x`` and ``y`` agree; the rest of a sketch is fetched only where its beginning agrees."""
    near = np.flatnonzero(W.popcount(x[i, 0] ^ y[j, 0]) + W.popcount(x[i, 1] ^ y[j, 1]) <= FIRST)
    i, j = i[near], j[near]
    ok = _apart(x[i], y[j]) <= 128 - AGREE
    return i[ok], j[ok]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs (train node, test node) with agreeing sketches, in blocks that fit the processor's cache."""
    out = [np.zeros((0, 2), np.uint64)]
    x, y = np.ascontiguousarray(a["sketch"]), np.ascontiguousarray(b["sketch"])
    x0, x1 = (np.ascontiguousarray(x[:, k])[:, None] for k in (0, 1))
    y0, y1 = (np.ascontiguousarray(y[:, k])[None, :] for k in (0, 1))
    held = [np.empty(CACHE * CACHE, kind) for kind in (np.uint64, np.uint8, np.uint8, np.bool_)]  # fresh memory for each block would cost as much again
    for i in range(0, len(a), CACHE):
        for j in range(0, len(b), CACHE):
            rows, columns = slice(i, i + CACHE), slice(j, j + CACHE)
            shape = (len(x0[rows]), y0[:, columns].shape[1])
            d, f, g, near = (t[: shape[0] * shape[1]].reshape(shape) for t in held)
            np.bitwise_count(np.bitwise_xor(x0[rows], y0[:, columns], out=d), out=f)
            np.bitwise_count(np.bitwise_xor(x1[rows], y1[:, columns], out=d), out=g)
            u = np.flatnonzero(np.less_equal(np.add(f, g, out=f), FIRST, out=near))
            if len(u):
                u, v = _alike(x, y, i + u // shape[1], j + u % shape[1])
                out.append(np.stack([a["node"][u], b["node"][v]], axis=1))
    return np.concatenate(out)


def _once(rows: np.ndarray) -> np.ndarray:
    """Rows by key; copies of a record that came in several batches count once, else pairs would grow with the product of the copies."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[new]


def _meet(a: np.ndarray, b: np.ndarray, told: np.ndarray, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate pairs, members of ``a`` and of ``b`` left to the blocks) of two row arrays that share a key.

    Left to the blocks are seeds whose sides multiply to over ``hot`` and those of which the maps told.
    """
    a, b = _once(a), _once(b)
    keys = np.intersect1d(a["key"], b["key"])
    a0, a1 = np.searchsorted(a["key"], keys), np.searchsorted(a["key"], keys, "right")
    b0, b1 = np.searchsorted(b["key"], keys), np.searchsorted(b["key"], keys, "right")
    na, nb = a1 - a0, b1 - b0
    out = [np.zeros((0, 2), np.uint64)]
    left = np.union1d(keys[na * nb > hot], told)
    later = np.isin(keys, left)
    easy = (na * nb <= EASY) & ~later
    # all small runs at once: enumerate (i, j) by counting
    x, y = np.ascontiguousarray(a["sketch"]), np.ascontiguousarray(b["sketch"])
    total = (na * nb)[easy]
    block = np.cumsum(total) // 2_000_000
    for k in np.unique(block):
        sel = np.flatnonzero(easy)[block == k]
        cells = (na * nb)[sel]
        where = np.repeat(sel, cells)
        at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        i, j = a0[where] + at // nb[where], b0[where] + at % nb[where]
        i, j = _alike(x, y, i, j)
        out.append(np.stack([a["node"][i], b["node"][j]], axis=1))
    for k in np.flatnonzero(~easy & ~later):
        out.append(_cross(a[a0[k] : a1[k]], b[b0[k] : b1[k]]))
        if sum(map(len, out[1:])) > HELD_PAIRS:  # alike records share many seeds
            out = [np.unique(np.concatenate(out), axis=0)]
    # a seed of which the maps told may stand on one side only here
    return np.unique(np.concatenate(out), axis=0), a[np.isin(a["key"], left)], b[np.isin(b["key"], left)]


def _pair_rows(pairs: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs as rows of FOUND."""
    both = np.ascontiguousarray(pairs.T).view(np.int64)
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(both[0]), pa.array(both[1]), *(pa.nulls(len(pairs), k) for k in kinds)], ["train", "test", "part", "key", "sketch"])


def _member_rows(part: np.ndarray, rows: np.ndarray, train: np.ndarray) -> pa.RecordBatch:
    """Members of seeds that are compared in blocks, as rows of FOUND with one node only."""
    node = np.ascontiguousarray(rows["node"]).view(np.int64)
    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(rows), [None, pa.py_buffer(rows["sketch"].tobytes())]).cast(pa.binary())
    sides = [pa.array(node, mask=~train), pa.array(node, mask=train)]
    return pa.record_batch([*sides, pa.array(part.astype(np.int32)), pa.array(rows["key"].astype(np.int64)), sketch], ["train", "test", "part", "key", "sketch"])


def _candidates(batches: Iterator[pa.RecordBatch], parts: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list, list]] = {}
    told: dict[int, list] = {}
    for batch in batches:
        for part, train, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = blob.as_buffer()
            if part == -1:
                rows = np.frombuffer(data, dtype=MEMBER)
                yield _member_rows(rows["part"], rows, rows["train"])
            elif part >= parts:
                told.setdefault(part - parts, []).append(np.frombuffer(data, dtype=np.uint32))
            else:
                held.setdefault(part, ([], []))[0 if train else 1].append(np.frombuffer(data, dtype=ROW))
    none = [np.zeros(0, ROW)]
    for part in list(held):
        a, b = held.pop(part)
        keys = np.concatenate(told.get(part, [np.zeros(0, np.uint32)]))
        pairs, train, test = _meet(np.concatenate(a or none), np.concatenate(b or none), keys, hot)
        yield _pair_rows(pairs)
        for rows, side in ((train, True), (test, False)):
            if len(rows):
                yield _member_rows(np.full(len(rows), part), rows, np.full(len(rows), side))


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one block of a hot seed."""
    side = {}
    for name in ("train", "test"):
        sel = pdf[pdf["side"] == name]
        rows = np.empty(len(sel), ROW)
        rows["node"] = sel["node"].to_numpy().view(np.uint64)
        rows["sketch"] = np.frombuffer(b"".join(sel["sketch"]), np.uint64).reshape(-1, WORDS)
        side[name] = rows
    pairs = _cross(side["train"], side["test"]).view(np.int64)
    return pd.DataFrame({"train": pairs[:, 0], "test": pairs[:, 1]})


def _hot_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (train, test) of seeds that are frequent on both sides: all train rows meet all test rows, SIDE by SIDE.

    ``members`` are distinct; a pair is given once for each seed and block it is found by.
    """
    run = ["part", "key"]
    node, side = F.coalesce("train", "test").alias("node"), F.when(F.col("train").isNotNull(), "train").otherwise("test").alias("side")
    rows = members.select(*run, node, side, "sketch")
    sizes = rows.groupBy(*run).agg(*(F.sum((F.col("side") == s).cast("int")).alias(s) for s in ("train", "test"))).where("train > 0 and test > 0")
    blocks = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    rows = rows.join(small(cut(sizes.select(*run, blocks("train").alias("across"), blocks("test").alias("down")), "sizes")), run)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    train = rows.where("side = 'train'").withColumn("i", mine("across")).withColumn("j", F.explode(every("down")))
    test = rows.where("side = 'test'").withColumn("i", F.explode(every("across"))).withColumn("j", mine("down"))
    both = train.select(*run, "i", "j", "node", "side", "sketch").union(test.select(*run, "i", "j", "node", "side", "sketch"))
    return both.groupBy(*run, "i", "j").applyInPandas(_block, "train long, test long")


def _nodes(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """(id, split, fields) to (id, split, node); a record without a word pair gets node null."""
    for batch in batches:
        columns = [batch.column(i + 2).to_pylist() for i in range(fields)]
        node, none = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for s in W.chunks(columns):
            w = W.words(_records(columns, s))
            hashes = W.mix(w.hashes + (w.owner() % fields).astype(np.uint64))
            node.append(W.order_print(hashes, w.first[::fields]).view(np.int64))
            none.append(W.pairs_of(w)[1][::fields][1:] == W.pairs_of(w)[1][::fields][:-1])
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(np.concatenate(node), mask=np.concatenate(none))], ["id", "split", "node"]
        )


def _lines(y: list[int], places: dict[int, int], full: int, v: int) -> list[int]:
    """The bit rows of the longest common subsequence after each item of ``y``; a zero bit is a step up."""
    out = []
    for h in y:
        u = v & places.get(h, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def chain(x: list[int], y: list[int], step: int = 512) -> list[tuple[int, int]]:
    """The longest run of equal items (i, j) rising in both places: the collinear chain of all common seeds.

    Bit-parallel (Hyyrö 2004), so repeated seeds cost no more than others; only every ``step``-th row is kept, the rows
    between are computed again on the way back.
    """
    if not x or not y:
        return []
    places: dict[int, int] = {}
    for i, h in enumerate(x):
        places[h] = places.get(h, 0) | 1 << i
    full = (1 << len(x)) - 1
    starts = [full]
    for j in range(0, len(y), step):
        starts.append(_lines(y[j : j + step], places, full, starts[-1])[-1])
    out = []
    i = len(x)
    for block in range((len(y) - 1) // step, -1, -1):
        rows = [starts[block], *_lines(y[block * step : block * step + step], places, full, starts[block])]
        j = len(rows) - 1
        while j and i:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif j and not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, block * step + j))
    return out[::-1]


def aligned(x: W.Words, y: W.Words, fx: int = 0, fy: int = 0, fields: int | None = None, sx: tuple | None = None, sy: tuple | None = None) -> int:
    """Words of a record of ``y`` covered by collinear seeds it has in common with one of ``x``, each extended as far as words agree.

    The records are the ``fields`` texts from ``fx`` and ``fy`` on (default: all); ``sx`` and ``sy`` are the winnowed seeds if at hand.
    """
    fields = len(x.first) - 1 if fields is None else fields
    covered = 0
    (px, hx), (py, hy) = sx or winnow(x), sy or winnow(y)
    for f in range(fields):
        x0, x1, y0, y1 = int(x.first[fx + f]), int(x.first[fx + f + 1]), int(y.first[fy + f]), int(y.first[fy + f + 1])
        inx, iny = slice(*np.searchsorted(px, (x0, x1))), slice(*np.searchsorted(py, (y0, y1)))
        p0, q0 = px[inx].tolist(), py[iny].tolist()
        a, b = x.hashes[x0:x1].tolist(), y.hashes[y0:y1].tolist()
        right = 0
        for i, j in chain(hx[inx].tolist(), hy[iny].tolist()):
            p, q = p0[i] - x0, q0[j] - y0
            if q < right:
                continue
            i, j = p, q
            while i > 0 and j > right and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            k = 0
            while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                k += 1
            covered += max(0, q + k - j)
            right = max(right, q + k)
    return covered


def _judge(batches: Iterator[pa.RecordBatch], fields: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """A partition of the grid (pairs and records) to the pairs of enough likeness with the coverage of the test record."""
    left, right, held = gather(batches)
    if not len(left):
        return
    # a record may be sent for its line and for its column
    names = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
    ids, first = np.unique(names, return_index=True)
    texts = [pa.chunked_array([b.column(2 + f) for b in held]).take(pa.array(first)) for f in range(fields)]
    columns = [t.to_pylist() for t in texts]
    values, sizes, words, at = [], [], [], []
    for s in W.chunks(columns):
        w = W.words(_records(columns, s))
        v, f = W.distinct((pairs := W.pairs_of(w))[0], pairs[1][::fields])
        values.append(v)
        sizes.append(np.diff(f))
        at += [(len(words), i) for i in range(s.stop - s.start)]
        words.append((w, winnow(w)))
    edges = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    i, j = np.searchsorted(ids, left), np.searchsorted(ids, right)
    like = likeness(np.concatenate(values), edges, i, j)
    good = np.flatnonzero(like >= threshold - 1e-12)
    coverage = []
    for k in good.tolist():
        (cx, x), (cy, y) = at[i[k]], at[j[k]]
        (wx, sx), (wy, sy) = words[cx], words[cy]
        total = int(wy.first[(y + 1) * fields] - wy.first[y * fields])
        coverage.append(aligned(wx, wy, x * fields, y * fields, fields, sx, sy) / max(1, total))
    yield pa.record_batch([pa.array(left[good]), pa.array(right[good]), pa.array(like[good]), pa.array(coverage, pa.float64())], ["train", "test", "likeness", "coverage"])


def overlap_links(
    rows: DataFrame,
    id_col: str = "sample_id",
    split_col: str = "split",
    fields: tuple[str, ...] = ("prompt", "chosen", "rejected"),
    train: str = "train",
    test: str = "test",
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the likenesses between a train and a test record, copies taken together.

    ``links`` is (train, test, likeness, coverage) between record prints, ``members`` (id, split, node) with the print of each
    record; records with the same words in the same fields have the same print.  A record that is in both splits is linked to itself.
    """
    n = len(fields)
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    rows = rows.where(F.col("id").isNotNull() & F.col("split").isin(train, test))
    kind = rows.schema["id"].dataType.simpleString()
    texts = [f"f{i}" for i in range(n)]
    # enough partitions for the seeds of all texts, so that a task's share doesn't grow with the input
    chars = rows.agg(*(F.sum(F.octet_length(t)) for t in texts)).first()
    parts = parts_for(ceil(SEED_BYTES * sum(c or 0 for c in chars)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = arrow_map(rows, lambda it: _nodes(it, n), f"id {kind}, split string, node long").where("node is not null")
    nodes = cut(nodes.distinct(), "nodes")
    hot, hot_batch = HOT, HOT_BATCH
    blobs = arrow_map(rows.select("split", *texts), lambda it: _pack(it, parts, train, n, threshold, hot_batch), "part int, train boolean, blob binary")
    found = arrow_map(blobs.repartitionById(parts, F.pmod("part", F.lit(parts))), lambda it: _candidates(it, parts, hot), FOUND).distinct()
    found = cut(found, "candidates")
    pairs = found.where("train is not null and test is not null").select("train", "test")
    members = found.where("train is null or test is null")
    if not members.isEmpty():
        ship(spark)
        pairs = cut(pairs.union(_hot_pairs(members)).distinct(), "pairs")
    # one record stands for all its copies while texts are fetched
    stands = nodes.groupBy("node").agg(F.min("id").alias("id"))
    wanted = pairs.select(F.col("train").alias("node")).union(pairs.select(F.col("test").alias("node"))).distinct()
    wanted = cut(stands.join(wanted, "node"), "wanted")
    held = rows.join(small(wanted, 64), "id").select("node", *texts).dropDuplicates(["node"])
    cells = grid(pairs.select(F.col("train").alias("a"), F.col("test").alias("b")), held, parts)
    good = arrow_map(cells, lambda it: _judge(it, n, threshold), "train long, test long, likeness double, coverage double")
    return cut(good, "links"), nodes


def cross_split_overlaps(
    rows: DataFrame,
    id_col: str = "sample_id",
    split_col: str = "split",
    fields: tuple[str, ...] = ("prompt", "chosen", "rejected"),
    train: str = "train",
    test: str = "test",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All pairs of a train and a test record whose likeness is at least ``threshold``.

    Returns (train_id, test_id, likeness, coverage): coverage is the share of the test record's words in
    extended, collinear seeds.  Repeated ids count once.  A null field counts as empty; records without any
    word pair match nothing.  Rows of other splits, null ids and extra columns are ignored; empty in, empty out.
    Copies are expanded into all pairs; ``overlap_links`` keeps them together.
    """
    links, nodes = overlap_links(rows, id_col, split_col, fields, train, test, threshold)
    a = nodes.where(F.col("split") == train).select(F.col("node").alias("train"), F.col("id").alias("train_id"))
    b = nodes.where(F.col("split") == test).select(F.col("node").alias("test"), F.col("id").alias("test_id"))
    return links.join(a, "train").join(b, "test").where("train_id <> test_id").select("train_id", "test_id", "likeness", "coverage")


def best_coverage(links: DataFrame, nodes: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    """(id, coverage): the greatest coverage among each record's overlaps with another record; no pair of copies is formed.

    A record whose only partner is itself (its id delivered in both splits) has none.
    """
    sides = nodes.groupBy("node").agg(*(F.min(F.when(F.col("split") == s, F.col("id"))).alias(f"{s}_low") for s in (train, test)), *(F.max(F.when(F.col("split") == s, F.col("id"))).alias(f"{s}_high") for s in (train, test)))
    out = None
    for mine, other, split, far in (("train", "test", train, test), ("test", "train", test, train)):
        partner = sides.select(F.col("node").alias(other), F.col(f"{far}_low").alias("low"), F.col(f"{far}_high").alias("high"))
        # the best link, and the best to a print that doesn't consist of the record itself
        per = links.join(partner, other).where("low is not null").withColumn("single", F.when(F.col("low") == F.col("high"), F.col("low")))
        per = per.groupBy(mine, "single").agg(F.max("coverage").alias("coverage"))
        one = nodes.where(F.col("split") == split).select("id", F.col("node").alias(mine)).join(per, mine).where("single is null or single <> id")
        one = one.groupBy("id").agg(F.max("coverage").alias("coverage"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.max("coverage").alias("coverage"))


def overlap_report(rows: DataFrame, links: DataFrame, nodes: DataFrame, id_col: str = "sample_id", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """Per split and source: records, records with an overlap in the other split, mean coverage of those, from ``overlap_links``.

    A null source is a source of its own; a source without overlaps has zero and a null mean.
    """
    best = best_coverage(links, nodes)
    one = rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source")).dropDuplicates(["id"])
    return (
        one.join(best, "id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("coverage").alias("overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    )
