"""Problem 4: near-duplicate prompts, grouped over chains of likeness.

Method: tensored banding.  Two collections of ``bands`` small hash collections, each of
``width`` min-hashes, are computed for every text; a table key joins one member of the first
collection with one of the second.  So ``bands * bands`` tables need only
``2 * bands * width`` min-hashes instead of ``2 * bands * bands * width``.  Candidates that
share a key are filtered by a one-bit sketch of 192 bits inside the table and then verified on
their exact word pairs.

Layout: a map task packs the table rows of a batch into one binary blob for each target
partition (12 + 24 bytes a row), reduces keys that are hot inside the batch, and a reduce task
sorts them with numpy.  Texts equal word for word share a fingerprint and count as one node,
so groups of copies never meet in a table more than once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.llm._graph import components
from prefloom.llm._verify import gather, grid, likeness, parts_for
from prefloom.session import arrow_map, cut, ship, small

THRESHOLD, BANDS, WIDTH = 0.6, 7, 2
#: Bits of 64 in which two sketches must agree; at likeness 0.6 about 51 do, with a deviation of 3.2.
AGREE = 44
#: Words of 64 further bits in a table row, and the bits of all in which two rows of a run must agree: 136 of 192 (likeness 0.6: about 154,
#: deviation 5.5; likeness 0.2: 115, deviation 6.8).  Without them pairs of likeness 0.1 to 0.3, of which there are quadratically many, pass.
MORE, AGREE_ALL = 2, 136
#: Runs up to ALL emit every pair; longer ones pair each member with NEAR neighbours in each of four
#: sketch orders and with CENTRES members common to the run, so the rows stay linear in the run.  Their members are
#: kept, and once components are known, those outside a run's largest component meet all others (``_rest``).
ALL, NEAR, CENTRES = 64, 8, 16
#: Members of a key that is hot within a batch which still go on to the key's reducer.
HOT_BATCH, ON = 256, 32
#: Rows of one side of a block in that second comparison.
SIDE = 4096

ROW = np.dtype([("key", "<u4"), ("node", "<u8"), ("sketch", "<u8"), ("more", "<u8", MORE)])
HELD = np.dtype([("part", "<i4"), ("key", "<u4"), ("node", "<u8"), ("sketch", "<u8")])
FOUND = "a long, b long, part int, key long, sketch long"


def _pair_rows(pairs: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs as rows of FOUND."""
    both = np.ascontiguousarray(pairs.T).view(np.int64)
    none = pa.nulls(len(pairs), pa.int64())
    return pa.record_batch([pa.array(both[0]), pa.array(both[1]), pa.nulls(len(pairs), pa.int32()), none, none], ["a", "b", "part", "key", "sketch"])


def _member_rows(part: np.ndarray, key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    """Members of runs that weren't paired whole, as rows of FOUND without a second node."""
    return pa.record_batch(
        [pa.array(node.view(np.int64)), pa.nulls(len(node), pa.int64()), pa.array(part.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(sketch.view(np.int64))],
        ["a", "b", "part", "key", "sketch"],
    )


def table_keys(sig: np.ndarray, bands: int = BANDS, width: int = WIDTH) -> np.ndarray:
    """The ``bands ** 2`` tensored keys of each signature row, table number mixed in."""
    with np.errstate(over="ignore"):
        small = np.zeros((len(sig), 2 * bands), dtype=np.uint64)
        for b in range(2 * bands):
            for j in range(width):
                small[:, b] = W.mix(small[:, b] + sig[:, b * width + j] + np.uint64(b + 1))
        left, right = small[:, :bands, None], small[:, None, bands:]
        return W.mix(left * np.uint64(3) + right).reshape(len(sig), bands * bands)


def _agreeing(node: np.ndarray, sketch: np.ndarray, more: np.ndarray | None, a: np.ndarray, b: np.ndarray, agree: int = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b) of different nodes whose sketches agree, by the further bits too if they are given."""
    apart = W.popcount(sketch[a] ^ sketch[b])
    ok = np.flatnonzero((apart <= 64 - agree) & (node[a] != node[b]))
    a, b = a[ok], b[ok]
    if more is None:
        return a, b
    ok = apart[ok] + W.popcount(more[a] ^ more[b]).sum(axis=1) <= 64 + 64 * MORE - AGREE_ALL
    return a[ok], b[ok]


def near_pairs(node: np.ndarray, sketch: np.ndarray, agree: int = AGREE, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one run of nodes that share a key (indices), filtered by sketch."""
    n = len(node)
    if n <= ALL:
        a, b = np.triu_indices(n, 1)
    else:
        left, right = [], []
        for turn in range(4):
            t = np.uint64(16 * turn)
            turned = (sketch << t) | (sketch >> (np.uint64(64) - t)) if turn else sketch
            order = np.argsort(turned, kind="stable")
            for d in range(1, NEAR + 1):
                left.append(order[:-d])
                right.append(order[d:])
        centre = np.argsort(W.mix(node ^ sketch[:1]), kind="stable")[:CENTRES]
        for c in centre:
            left.append(np.full(n, c))
            right.append(np.arange(n))
        a, b = np.concatenate(left), np.concatenate(right)
    return _agreeing(node, sketch, more, a, b, agree)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of two or more equal keys in a sorted array."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    keep = np.diff(edge) > 1
    return edge[:-1][keep], edge[1:][keep]


def run_pairs(start: np.ndarray, end: np.ndarray, node: np.ndarray, sketch: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Distinct candidate pairs (two columns of nodes) of all runs; short runs go by length, all at once."""
    found = []
    size = end - start
    for n in np.unique(size[size <= ALL]):
        at = start[size == n]
        i, j = np.triu_indices(int(n), 1)
        for block in range(0, len(at), max(1, 2_000_000 // len(i))):
            part = at[block : block + max(1, 2_000_000 // len(i))]
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            a, b = _agreeing(node, sketch, more, a, b)
            found.append(np.stack([node[a], node[b]], axis=1))
    for s, e in zip(start[size > ALL], end[size > ALL], strict=True):
        a, b = near_pairs(node[s:e], sketch[s:e], more=None if more is None else more[s:e])
        found.append(np.stack([node[s:e][a], node[s:e][b]], axis=1))
    if not found:
        return np.zeros((0, 2), np.uint64)
    pairs = np.concatenate(found)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _pack(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Text batches to blobs of table rows, one for each target partition p.

    Part -1 holds finished pairs, -2 members of hot keys that stay behind, ``parts + p`` the hot keys themselves.
    """
    for batch in batches:
        texts = batch.column(0).to_pylist()
        nodes, sketches, further, keys = [], [], [], []
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            pairs, first = W.pairs_of(w)
            node = W.order_print(w.hashes, w.first)
            some = np.flatnonzero(np.diff(first) > 0)
            sig = W.minima(pairs, first, 64)[some]
            nodes.append(node[some])
            sketches.append(W.one_bit(sig))
            further.append(W.long_sketch(pairs, first, MORE, seed=2)[some])
            keys.append(table_keys(sig))
        if not nodes:
            continue
        node, at = np.unique(np.concatenate(nodes), return_index=True)
        if not len(node):
            continue
        key = np.concatenate(keys)[at]
        sketch, more = np.concatenate(sketches)[at], np.concatenate(further)[at]
        tables = key.shape[1]
        key = key.ravel()
        order = np.argsort(key, kind="stable")
        owner = order // tables
        key, node, sketch, more = key[order], node[owner], sketch[owner], more[owner]
        out_part, out_blob = [], []
        # partition by the high part of the key, so that the sorted array falls into slices
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        start, end = _runs(key)
        hot = end - start > HOT_BATCH
        if hot.any():
            keep = np.ones(len(key), dtype=bool)
            done = run_pairs(start[hot], end[hot], node, sketch, more)
            for s, e in zip(start[hot], end[hot], strict=True):
                keep[s + np.argsort(W.mix(node[s:e]))[ON:]] = False
            out_part.append(-1)
            out_blob.append(done.tobytes())
            # those that stay behind are members of the run all the same
            rows = np.empty(int((~keep).sum()), dtype=HELD)
            rows["part"], rows["key"], rows["node"], rows["sketch"] = part[~keep], key[~keep].astype(np.uint32), node[~keep], sketch[~keep]
            out_part.append(-2)
            out_blob.append(rows.tobytes())
            # the reducer is told, so that all other members of such a run are kept too, however short it is there
            for p in np.unique(part[start[hot]]):
                out_part.append(parts + int(p))
                out_blob.append(key[start[hot]][part[start[hot]] == p].astype(np.uint32).tobytes())
            key, node, sketch, more, part = key[keep], node[keep], sketch[keep], more[keep], part[keep]
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows = np.empty(len(key), dtype=ROW)
        rows["key"], rows["node"], rows["sketch"], rows["more"] = key.astype(np.uint32), node, sketch, more
        for p in range(parts):
            if edges[p] < edges[p + 1]:
                out_part.append(p)
                out_blob.append(rows[edges[p] : edges[p + 1]].tobytes())
        yield pa.record_batch([pa.array(out_part, pa.int32()), pa.array(out_blob, pa.binary())], ["part", "blob"])


def _candidates(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All blobs of a reduce task to candidate pairs, and the members of runs above ALL or hot in a batch."""
    held: dict[int, list[np.ndarray]] = {}
    hot: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = blob.as_buffer()
            if part == -1:
                yield _pair_rows(np.frombuffer(data, dtype=np.uint64).reshape(-1, 2))
            elif part == -2:
                rows = np.frombuffer(data, dtype=HELD)
                yield _member_rows(rows["part"], rows["key"], np.ascontiguousarray(rows["node"]), np.ascontiguousarray(rows["sketch"]))
            elif part >= parts:
                hot.setdefault(part - parts, []).append(np.frombuffer(data, dtype=np.uint32))
            else:
                held.setdefault(part, []).append(np.frombuffer(data, dtype=ROW))
    for part in list(held):
        rows = np.concatenate(held.pop(part))
        rows = rows[np.lexsort((rows["node"], rows["key"]))]
        again = np.zeros(len(rows), bool)  # copies of a text that came in several batches are one member
        again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
        rows = rows[~again]
        node, sketch, more = (np.ascontiguousarray(rows[c]) for c in ("node", "sketch", "more"))
        start, end = _runs(rows["key"])
        yield _pair_rows(run_pairs(start, end, node, sketch, more))
        kept = end - start > ALL
        if part in hot:
            kept |= np.isin(rows["key"][start], np.concatenate(hot[part]))
        for s, e in zip(start[kept], end[kept], strict=True):
            yield _member_rows(np.full(e - s, part), rows["key"][s:e], node[s:e], sketch[s:e])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of a long run: its outsiders against all its rows of other components."""
    out = pdf[pdf["outside"]]
    x, y = out["sketch"].to_numpy().view(np.uint64), pdf["sketch"].to_numpy().view(np.uint64)
    near = W.popcount(x[:, None] ^ y[None, :]) <= 64 - AGREE
    near &= out["root"].to_numpy()[:, None] != pdf["root"].to_numpy()[None, :]
    i, j = np.nonzero(near)
    a, b = out["a"].to_numpy()[i].view(np.uint64), pdf["a"].to_numpy()[j].view(np.uint64)
    pairs = np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _rest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates that the sparse pairing of long runs may have left out.

    Only members outside their run's largest component can still be unlinked to another member; they meet all members of other
    components, in blocks of SIDE rows by SIDE rows, so no run is gathered in one task and no pair within a component is formed.
    """
    run = ["part", "key"]
    rows = members.select(*run, "a", "sketch").distinct().join(roots, F.col("a") == F.col("node"), "left")
    rows = cut(rows.select(*run, "a", "sketch", F.coalesce("root", "a").alias("root")), "members")
    sizes = rows.groupBy(*run, "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*run).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"))
    main = main.where("total > most")
    rows = rows.join(main, run).withColumn("outside", F.col("root") != F.col("main"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / SIDE)).cast("int")
    rows = rows.withColumn("across", blocks(F.col("total") - F.col("most"))).withColumn("down", blocks(F.col("total")))
    mine = F.pmod(F.xxhash64("a"), F.col("across")).cast("int")
    row = F.pmod(F.xxhash64("a", F.lit(1)), F.col("down")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # an outsider stands in all blocks of its column; every row in all blocks of its line
    as_outsider = rows.where("outside").withColumn("i", mine).withColumn("j", F.explode(every(F.col("down"))))
    as_row = rows.withColumn("outside", F.lit(False)).withColumn("i", F.explode(every(F.col("across")))).withColumn("j", row)
    block = as_outsider.union(as_row).select(*run, "i", "j", "a", "sketch", "root", "outside")
    return block.groupBy(*run, "i", "j").applyInPandas(_meet, "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (node, distinct word pairs as 32-bit values)."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            pairs, first = W.pairs_of(w)
            node = W.order_print(w.hashes, w.first)
            node, at = np.unique(node, return_index=True)
            v, f = W.distinct((pairs >> np.uint64(32)).astype(np.uint32), first)
            size = np.diff(f)
            take = np.concatenate([np.arange(f[i], f[i + 1]) for i in at]) if len(at) else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(size[at]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[take].view(np.int32)))
            yield pa.record_batch([pa.array(node.view(np.int64)), values], ["node", "pairs"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, node); texts without a word get node null."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        node = [np.zeros(0, np.int64)]
        none = [np.zeros(0, bool)]
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            node.append(W.order_print(w.hashes, w.first).view(np.int64))
            none.append(w.counts == 0)
        yield pa.record_batch(
            [batch.column(0), pa.array(np.concatenate(node), mask=np.concatenate(none))], ["id", "node"]
        )


def _alike(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A partition of the grid (pairs and sets) to the pairs of enough likeness."""
    left, right, held = gather(batches)
    if not len(left):
        return
    names = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
    ids, at = np.unique(names, return_index=True)  # a node may be sent for its line and for its column
    lists = pa.chunked_array([b.column(2) for b in held]).take(pa.array(at)).combine_chunks()
    first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    good = likeness(values, first, np.searchsorted(ids, left), np.searchsorted(ids, right)) >= threshold - 1e-12
    yield pa.record_batch([pa.array(left[good]), pa.array(right[good])], ["a", "b"])


def _verify(one: DataFrame, found: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Candidate pairs (a, b) whose exact likeness is at least ``threshold``."""
    wanted = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    sets = arrow_map(one, _sets, "node long, pairs array<int>").join(small(cut(wanted, "wanted")), "node", "left_semi")
    cells = grid(found, sets.dropDuplicates(["node"]), parts)
    return arrow_map(cells, lambda it: _alike(it, threshold), "a long, b long")


def text_components(texts: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): the component of every text fingerprint that has a link of likeness ``threshold``."""
    ship(texts.sparkSession)
    one = texts.select(F.col(text).alias("text")).where("text is not null")
    # enough partitions for the table rows of all texts, so that a task's share doesn't grow with the input
    parts = parts_for(one.count() * BANDS * BANDS * ROW.itemsize, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blobs = arrow_map(one, lambda it: _pack(it, parts), "part int, blob binary")
    found = arrow_map(blobs.repartitionById(parts, F.pmod("part", F.lit(parts))), lambda it: _candidates(it, parts), FOUND).distinct()
    found = cut(found, "candidates")
    pairs, members = found.where("b is not null").select("a", "b"), found.where("b is null")
    links = _verify(one, pairs, threshold, parts)
    if members.isEmpty():
        return components(links, "a", "b")
    links = cut(links, "links")
    roots = components(links, "a", "b")
    more = cut(_rest(members, roots), "rest")
    if more.isEmpty():
        return roots
    return components(links.union(_verify(one, more, threshold, parts)), "a", "b")


def near_duplicate_groups(rows: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Group rows whose texts are linked by chains of likeness ``threshold`` or more.

    Returns (``id_col``, ``group_id``), one row for each member of a group of two or more;
    ``group_id`` is the least id.  Repeated ids count once.  Null texts and texts without a word
    belong to no group (they have no word pair to share); a text of one word groups
    only with the same word.  Null ids are dropped, other columns are ignored, an empty table gives
    an empty result.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    nodes = arrow_map(rows.where("text is not null"), _nodes, f"id {kind}, node long").where("node is not null")
    nodes = cut(nodes.distinct(), "nodes")
    roots = text_components(rows, "text", threshold)
    # per fingerprint first: a text with very many copies is one row from here on
    texts = nodes.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    texts = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = texts.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("copies").alias("members"))
    labels = texts.join(groups.where("members > 1"), "root").select("node", "group_id")
    return nodes.join(labels, "node").select(F.col("id").alias(id_col), "group_id")
