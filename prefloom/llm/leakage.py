"""Problem 8: passages and questions of held-out items inside a training corpus.

Method: a BM25 inverted index of the items' passages and questions with block maxima.  Every passage of
the corpus (windows of ``WINDOW`` words) is a query.  Posting lists are in unit order and cut into blocks of ``BLOCK`` units with
the greatest weight in each.  As in block-max WAND, a window is given up as soon as its terms' greatest weights cannot reach any
threshold, a block is opened only if the block maxima of the window's terms can reach the least threshold in it, and postings are
read in opened blocks only; all units that reach their threshold are retrieved.  A unit's threshold is the least score
that a run of ``RUN`` of its words can have after its ``RUN // CHANGED`` best words were changed, so no such run
is missed.  Retrieved pairs are verified by aligning the words of the passage and of the question.

The index is built by the executors in shards of a bounded size; each shard is one pass over the corpus, of which nothing is collected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.session import arrow_map, cut

#: A leak is RUN words in a row of which at most one in CHANGED is changed or missing.
RUN, CHANGED = 24, 8
#: Query windows: any span of WINDOW - STRIDE words lies within one.
WINDOW, STRIDE = 48, 20
K1, B = 1.2, 0.75
BLOCK = 8
#: Such a run keeps an unbroken piece of at least this many words: (RUN - RUN // CHANGED) over RUN // CHANGED + 1 pieces, less one.
PIECE = 5
#: Bytes of item text in a shard of the index, which is broadcast; the index takes about ten times as much.
SHARD_BYTES = 16 << 20
PASSAGE, QUESTION = 1, 2


@dataclass
class Shard:
    """Sorted term hashes, posting lists in unit order, their blocks, thresholds, and the units."""

    terms: np.ndarray
    greatest: np.ndarray  # of each term, and zero for words that are no term
    unit: np.ndarray  # postings
    weight: np.ndarray
    block_key: np.ndarray  # term * blocks + block, rising
    block_first: np.ndarray  # first posting of each, and the end
    block_max: np.ndarray
    least: np.ndarray
    block_least: np.ndarray
    units: list[list[int]]
    items: list[list[tuple[int, int]]]  # (item, PASSAGE or QUESTION)
    pieces: np.ndarray
    unit_pieces: list[frozenset]


def split_item(text: str | None) -> tuple[str, str]:
    """(passage, question) of an item: an optional line of instruction, a passage, and the question on the last line."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return "", ""
    if len(lines) == 1:
        return lines[0], ""
    body = lines[:-1]
    if len(body) > 1 and len(W.words([body[0]]).hashes) < RUN:
        body = body[1:]
    return " ".join(body), lines[-1]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row (one for each start that has n words)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return out


def build_index(items: list[tuple]) -> Shard:
    """Index (item id, text) rows; equal passages or questions are one unit that stands for all their items."""
    owners: dict[tuple[int, ...], list] = {}
    for item, text in items:
        for kind, part in zip((PASSAGE, QUESTION), split_item(text), strict=True):
            h = tuple(W.words([part]).hashes.tolist())
            if len(h) >= RUN - RUN // CHANGED:
                mine = owners.setdefault(h, [])
                if (item, kind) not in mine:
                    mine.append((item, kind))
    # units with common words lie side by side, so that blocks are alike
    order = sorted(owners, key=lambda h: (min(h), h))
    n = len(order)
    blocks = max(1, -(-n // BLOCK))
    terms = np.unique(np.array([t for h in order for t in set(h)], dtype=np.uint64))
    mean = sum(map(len, order)) / max(1, n)
    posting: list[tuple[int, int, int]] = []
    for u, h in enumerate(order):
        t, tf = np.unique(np.array(h, dtype=np.uint64), return_counts=True)
        posting += zip(np.searchsorted(terms, t).tolist(), [u] * len(t), tf.tolist(), strict=True)
    term, unit, tf = (np.array(c, dtype=np.int64) for c in zip(*sorted(posting), strict=True)) if posting else (np.zeros(0, np.int64),) * 3
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    length = np.array([len(h) for h in order], dtype=np.float64)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[unit] / max(mean, 1e-9)))
    of = {(int(t), int(u)): float(w) for t, u, w in zip(term, unit, weight, strict=True)}
    least = np.full(blocks * BLOCK, np.inf)
    for u, h in enumerate(order):
        own = {t: of[(int(np.searchsorted(terms, np.uint64(t))), u)] for t in set(h)}
        for i in range(max(1, len(h) - RUN + 1)):
            # a changed word may take away every copy of itself in the run
            best = sorted((own[t] for t in set(h[i : i + RUN])), reverse=True)
            least[u] = min(least[u], sum(best[RUN // CHANGED :]))
    key = term * blocks + unit // BLOCK
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    greatest = np.zeros(len(terms) + 1)
    np.maximum.at(greatest, term, weight)
    pieces = [_grams(np.array(h, dtype=np.uint64), PIECE) for h in order]
    return Shard(
        terms, greatest, unit.astype(np.int32), weight, key[edge], np.append(edge, len(key)), np.maximum.reduceat(weight, edge) if len(edge) else np.zeros(0), least,
        least.reshape(-1, BLOCK).min(axis=1), [list(h) for h in order], [owners[h] for h in order], np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64), [frozenset(g.tolist()) for g in pieces],
    )


def leaked_run(unit: list[int], text: list[int]) -> int:
    """Length of the longest run of ``unit`` found in ``text`` with at most one word in CHANGED changed or missing; 0 if under RUN."""
    there = set(text)
    held = np.concatenate(([0], np.cumsum([h in there for h in unit])))
    # a longer run may miss up to two words more within the RUN words of it that miss the least
    if len(unit) < RUN or (held[RUN:] - held[:-RUN]).max() < RUN - RUN // CHANGED - 2:
        return 0
    match = np.full(len(unit), -1)
    for m in SequenceMatcher(None, unit, text, autojunk=False).get_matching_blocks():
        match[m.a : m.a + m.size] = np.arange(m.b, m.b + m.size)
    hit = np.concatenate(([0], np.cumsum(match >= 0)))
    best = 0
    n = len(unit)
    for size in range(RUN, n + 1):
        ok = np.flatnonzero(hit[size:] - hit[:-size] >= size - size // CHANGED)
        for i in ok:
            at = match[i : i + size]
            # the run's own ends are there, and it lies close together in the text
            if at[0] >= 0 and at[-1] >= 0 and at[-1] - at[0] + 1 <= size + size // CHANGED:
                best = size
                break
        if not len(ok) and best:
            break
    return best


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (first, size) laid end to end: which range each place belongs to, and the place itself."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


def _evaluate(shard: Shard, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, unit, score) of all units whose threshold the windows' terms (rows of ``q``, each once, unknown ones last) reach."""
    blocks, none = len(shard.block_least), len(shard.terms)
    row, column = np.nonzero(q < none)
    term = q[row, column].astype(np.int64)
    # block maxima of each window's terms, added up by block
    low, high = np.searchsorted(shard.block_key, term * blocks), np.searchsorted(shard.block_key, (term + 1) * blocks)
    which, at = _spread(low, high - low)
    cell = row[which] * blocks + shard.block_key[at] % blocks
    bound = np.bincount(cell, weights=shard.block_max[at], minlength=len(q) * blocks)
    opened = bound >= np.tile(shard.block_least, len(q)) - 1e-6
    # postings of opened blocks only
    keep = opened[cell]
    at, cell = at[keep], cell[keep]
    which, posting = _spread(shard.block_first[at], shard.block_first[at + 1] - shard.block_first[at])
    window = cell[which] // blocks
    names, place = np.unique(window * (blocks * BLOCK) + shard.unit[posting], return_inverse=True)
    score = np.bincount(place, weights=shard.weight[posting], minlength=len(names))
    unit = names % (blocks * BLOCK)
    good = score >= shard.least[unit] - 1e-6
    return names[good] // (blocks * BLOCK), unit[good], score[good]


def _retrieve(shard: Shard, w: W.Words) -> list[tuple[int, int, float, int, int]]:
    """(text, unit, score, first word, end word) of all windows that reach a unit's threshold."""
    n = len(w.hashes)
    if not n or not len(shard.terms):
        return []
    at = np.minimum(np.searchsorted(shard.terms, w.hashes), len(shard.terms) - 1)
    term = np.where(shard.terms[at] == w.hashes, at, len(shard.terms))
    grams = _grams(w.hashes, PIECE)
    seen = np.zeros(n + 1, np.int64)
    if len(grams):
        k = np.minimum(np.searchsorted(shard.pieces, grams), len(shard.pieces) - 1)
        seen[1 : len(grams) + 1] = shard.pieces[k] == grams
    seen = np.cumsum(seen)
    most = np.concatenate(([0.0], np.cumsum(shard.greatest[term])))
    counts = w.counts
    number = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = w.first[:-1][text] + place * STRIDE
    stop = np.minimum(start + WINDOW, w.first[1:][text])
    # given up: windows whose terms cannot reach any threshold, and those without an unbroken piece of some unit, which hold no run
    live = np.flatnonzero((most[stop] - most[start] >= shard.block_least.min() - 1e-6) & (seen[np.maximum(stop - PIECE + 1, start)] - seen[start] > 0))
    out = []
    for b in range(0, len(live), 2048):
        some = live[b : b + 2048]
        s, e = start[some], stop[some]
        grid = s[:, None] + np.arange(WINDOW)
        q = np.sort(np.where(grid < e[:, None], term[np.minimum(grid, n - 1)], len(shard.terms)), axis=1)
        q[:, 1:][q[:, 1:] == q[:, :-1]] = len(shard.terms)  # each term counts once
        for i, unit, score in zip(*(c.tolist() for c in _evaluate(shard, q)), strict=True):
            # the window must hold an unbroken piece of this very unit
            if not shard.unit_pieces[unit].isdisjoint(grams[s[i] : e[i] - PIECE + 1].tolist()):
                out.append((int(text[some[i]]), unit, score, int(s[i]), int(e[i])))
    return out


def _search(batches: Iterator[pa.RecordBatch], shard: Shard) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        rows: list[tuple] = []
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            spans: dict[tuple[int, int], list] = {}
            for text, unit, score, a, e in _retrieve(shard, w):
                spans.setdefault((text, unit), []).append((a, e, score))
            for (text, unit), found in spans.items():
                best, top = 0, max(f[2] for f in found)
                low, high = int(w.first[text]), int(w.first[text + 1])
                merged: list[list[int]] = []
                for a, e, _ in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([a, e])
                for a, e in merged:
                    piece = w.hashes[max(low, a - RUN) : min(high, e + RUN)].tolist()
                    best = max(best, leaked_run(shard.units[unit], piece))
                if best:
                    rows += [(s.start + text, item, top, best if kind == PASSAGE else 0, best if kind == QUESTION else 0) for item, kind in shard.items[unit]]
        yield pa.record_batch(
            [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32())))],
            ["id", "item_id", "score", "passage_run", "question_run"],
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of one partition to its pickled shard."""
    rows = {(i, t or "") for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
    if rows:
        yield pa.record_batch([pa.array([pickle.dumps(build_index(sorted(rows)))], pa.binary())], ["shard"])


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents that hold passages or questions of items (item_id, text).

    Returns (``id_col``, item_id, score, passage_run, question_run, run), once for each pair: the best BM25 score of a window, the longest
    verified run of the item's passage and of its question (0: none), and the longer of both.
    Null and short texts hold nothing; items with equal passages all count; null ids are dropped; empty tables give an
    empty result.  Items beyond ``shard_bytes`` of text make further shards, each another pass over the documents; the
    driver holds one shard at a time, and statistics of terms are those of the shard, which leaves no run unfound.
    """
    spark = documents.sparkSession
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / shard_bytes))
    shards = cut(arrow_map(rows.repartition(parts, "item_id"), _build, "shard binary").withColumn("no", F.spark_partition_id()), "shards")
    picked = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, score double, passage_run int, question_run int"
    found = None
    numbers = sorted(r[0] for r in shards.select("no").collect())
    for no in numbers:
        held = spark.sparkContext.broadcast(pickle.loads(shards.where(F.col("no") == no).first()["shard"]))
        part = arrow_map(picked, lambda it, held=held: _search(it, held.value), schema)
        if len(numbers) > 1:
            part = cut(part, "leaks")
            held.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    out = found.groupBy("id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "passage_run", "question_run")))
    return out.withColumn("run", F.greatest("passage_run", "question_run")).withColumnRenamed("id", id_col)


def leak_report(leaks: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per item: its suite, the documents that hold it, and the longest run; items without a leak have zero and null."""
    per = leaks.groupBy("item_id").agg(F.countDistinct(id_col).alias("documents"), F.max("run").alias("longest_run"))
    return items.select("item_id", "suite").join(per, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "longest_run")
