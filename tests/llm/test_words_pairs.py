"""Word hashing, near duplicates and cross-split overlaps against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.llm import _verify as V
from prefloom.llm import _words as W
from prefloom.llm import cross_split as C
from prefloom.llm import near_duplicates as N

WORD = re.compile(r"[^\W_]+")
VOCAB = [f"w{i}" for i in range(4000)]


def words_of(t):
    return WORD.findall((t or "").lower())


def shingles(*texts):
    return {p for t in texts for w in [words_of(t)] for p in zip(w, w[1:], strict=False)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_words_match_a_regular_expression(texts):
    w = W.words(texts)
    for i, t in enumerate(texts):
        mine = [w.text[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        want = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        assert mine == [x for x in want if x]
        assert [W.word_hash(x) for x in mine] == w.hashes[w.first[i] : w.first[i + 1]].tolist()


def test_pairs_and_prints():
    w = W.words(["a b c a b", "x", "", "a b c a b!"])
    p, f = W.pairs_of(w)
    assert np.diff(f).tolist() == [4, 0, 0, 4] and p[0] == p[3]
    v, g = W.distinct(p, f)
    assert np.diff(g).tolist() == [3, 0, 0, 3]
    o = W.order_print(w.hashes, w.first)
    assert o[0] == o[3] != o[1] and o[2] == 0


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = rng.choice(VOCAB)
        elif kind == 1:
            w.insert(i, rng.choice(VOCAB))
        elif len(w) > 5:
            del w[i]
    return " ".join(w)


def groups(rows):
    """Brute force: {id: least id of its chain}, members of groups only."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same_words = words_of(dict(rows)[a]) == words_of(dict(rows)[b]) != []
            if same_words or likeness(sets[a], sets[b]) >= 0.6:
                a0, b0 = find(a), find(b)
                root[max(a0, b0)] = min(a0, b0)
    out = {i: find(i) for i in ids}
    return {i: g for i, g in out.items() if sum(h == g for h in out.values()) > 1}


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for base in range(40):
        t = text(rng, 60)
        rows += [(base * 10 + k, edited(rng, t, rng.randrange(0, 12))) for k in range(rng.randrange(1, 4))]
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "one"), (1004, "One!"), (1005, "x " * 30_000)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("node", F.lit(1)).withColumn("group_id", F.lit(2))
    got = {r.id: r.group_id for r in N.near_duplicate_groups(df.union(df), "id", "t").collect()}
    assert got == groups(rows)


def test_tables_are_tensored():
    sig = np.arange(64, dtype=np.uint32)[None, :]
    keys = N.table_keys(sig, 3, 2)
    assert keys.shape == (1, 9) and len(set(keys[0].tolist())) == 9
    other = sig.copy()
    other[0, 6:12] = 0  # the whole second collection changes
    assert not set(N.table_keys(other, 3, 2)[0].tolist()) & set(keys[0].tolist())
    other = sig.copy()
    other[0, 0:4] = 0  # two of three members of the first collection
    assert len(set(N.table_keys(other, 3, 2)[0].tolist()) & set(keys[0].tolist())) == 3


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies and small edits of one text: found whole, and no pair count grows with the square."""
    rng = random.Random(2)
    base = text(rng, 60)
    hot = [(i, base if i % 2 else edited(rng, base, 3)) for i in range(700)]
    rest = [(1000 + i, text(rng, 60)) for i in range(1400)]
    df = spark.createDataFrame(hot + rest, "id long, t string")
    out = N.near_duplicate_groups(df.repartition(5), "id", "t").collect()
    assert {(r.id, r.group_id) for r in out} == {(i, 0) for i in range(700)}
    n = 5000
    node = np.arange(n, dtype=np.uint64) + np.uint64(7)
    a, _ = N.near_pairs(node, np.zeros(n, np.uint64))
    assert len(a) < 60 * n


def test_long_runs_are_finished(spark, monkeypatch):
    """Whatever the sparse pairing left out between components is compared after all."""
    monkeypatch.setattr(N, "SIDE", 16)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows, root = [], {}
    for key in range(2):
        for i in range(120):
            node = key * 1000 + i
            near = centres[0] if i < 80 else centres[rng.randrange(3)]
            rows.append((node, 1, key, (near ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))))
            root[node] = key * 1000 if i < 70 else node - node % 3
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    members = spark.createDataFrame([(a, p, k, signed(x)) for a, p, k, x in rows], "a long, part int, key long, sketch long")
    roots = spark.createDataFrame([(a, r) for a, r in root.items() if a % 5], "node long, root long")
    real = {a: root[a] if a % 5 else a for a in root}
    got = {(r.a, r.b) for r in N._rest(members.union(members), roots).collect()}
    want = {(a, b) for a, _, k, x in rows for b, _, l, y in rows if a < b and k == l and real[a] != real[b] and bin(x ^ y).count("1") <= 64 - N.AGREE}
    assert got == want and len(want) > 500


def test_keys_hot_in_one_batch_keep_all_members():
    """Rows of other batches and those sent on are members too, even where the reducer's run is short."""
    rng = random.Random(8)
    base, parts = text(rng, 60), 3
    one = [edited(rng, base, 1) for _ in range(500)]
    other = [edited(rng, base, 1) for _ in range(20)]
    blobs = [pa.record_batch([b["part"], b["blob"]], ["part", "blob"]) for t in (one, other) for b in N._pack(iter([pa.record_batch([pa.array(t)], ["text"])]), parts)]
    got = {}
    for p in range(parts):
        mine = [b.filter(pa.array([x % parts == p for x in b["part"].to_pylist()])) for b in blobs]
        for b in N._candidates(iter(mine), parts):
            for a, other_node, part, key in zip(*(b[c].to_pylist() for c in ("a", "b", "part", "key")), strict=True):
                if other_node is None:
                    got.setdefault((part, key), set()).add(a)
    want, hot = {}, {}
    for turn, texts in enumerate((one, other)):
        w = W.words(texts)
        pairs, first = W.pairs_of(w)
        for node, keys in zip(W.order_print(w.hashes, w.first).view(np.int64).tolist(), N.table_keys(W.minima(pairs, first, 64)).tolist(), strict=True):
            for k in keys:
                name = (((k >> 32) * parts) >> 32, k & 0xFFFFFFFF)
                want.setdefault(name, set()).add(node)
                if not turn:
                    hot.setdefault(name, set()).add(node)
    hot = {k for k, v in hot.items() if len(v) > N.HOT_BATCH}
    assert hot and all(got.get(k) == want[k] for k in hot)


def packed(*batches):
    """Pairs and members of text batches."""
    blobs = [b for t in batches for b in N._pack(iter([pa.record_batch([pa.array(t)], ["text"])]), 1)]
    rows = [r for b in N._candidates(iter(blobs), 1) for r in b.to_pylist()]
    return {(r["a"], r["b"]) for r in rows if r["b"] is not None}, [r for r in rows if r["b"] is None]


def test_texts_that_share_a_phrase_are_no_candidates():
    """Likeness about 0.25 by a common phrase: such pairs grow with the square of the texts, so nearly none may pass the sketch."""
    rng = random.Random(13)
    phrase = text(rng, 33)
    texts = [f"{phrase} {text(rng, 50)}" for _ in range(250)]
    assert 0.2 < likeness(shingles(texts[0]), shingles(texts[1])) < 0.3
    assert len(packed(texts)[0]) < 0.002 * 250 * 250 / 2


def test_copies_from_many_batches_are_one_member():
    """Copies make no run long, so its pairs are formed whole and none of its rows are kept for later."""
    rng = random.Random(14)
    base = text(rng, 60)
    texts = [base, edited(rng, base, 2), edited(rng, base, 2)]
    once, copied = packed(texts), packed(*[texts] * 40)
    assert len(once[0]) == 3 and copied == once and not copied[1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert N.near_duplicate_groups(empty, "id", "t").count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "a b c")], "id long, t string")
    assert N.near_duplicate_groups(nothing, "id", "t").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_winnowing_never_misses_a_shared_run(seed):
    rng = random.Random(seed)
    run = text(rng, C.GRAM + C.WINDOW - 1)
    a = W.words([text(rng, rng.randrange(30)) + " " + run + " " + text(rng, rng.randrange(30))])
    b = W.words([text(rng, rng.randrange(30)) + " " + run + " " + text(rng, rng.randrange(30))])
    assert set(C.winnow(a)[1].tolist()) & set(C.winnow(b)[1].tolist())


def test_winnowing_short_texts():
    w = W.words(["a", "a b", "a b c d e", "", "z"])
    at, h = C.winnow(w)
    owners = w.owner()[at].tolist()
    assert owners == [0, 1, 2, 4] and C.winnow(W.words(["a"]))[1][0] == h[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_chain_is_a_longest_common_subsequence(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    got = C.chain(x, y, 3)
    assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_repetitive_texts_are_covered_whole():
    """More repeats of a seed than any fixed number of places."""
    phrase = "the quick brown fox jumps over a lazy dog near my old red barn today "
    x, y = W.words([phrase * 3 + "end"]), W.words([phrase * 200])
    assert C.aligned(y, y) == 200 * 15
    assert C.aligned(y, x) == 45
    assert C.aligned(x, y) == 45


def test_word_pairs_in_common_are_counted():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80)).astype(np.uint64)) for _ in range(60)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    left, right = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    got = V.common(np.concatenate(sets), first, left, right)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]


def records(rng, n):
    rows = []
    for i in range(n):
        p, c, r = text(rng, 60), text(rng, 70), text(rng, 70)
        rows.append([i * 2, "train", "s", p, c, r])
        if i % 3 == 0:
            rows.append([i * 2 + 1, "test", None, *(edited(rng, x, rng.randrange(0, 14)) for x in (p, c, r))])
    rows += [[900, "train", "s", "short words here", None, None], [901, "test", "s", "Short words, here", "", None], [902, "test", "s", None, None, None], [903, "train", "s", None, None, None], [904, "dev", "s", "short words here", None, None]]
    return rows


def test_cross_split_pairs_match_brute_force(spark):
    rows = records(random.Random(3), 60)
    df = spark.createDataFrame(rows, "sample_id long, split string, source string, prompt string, chosen string, rejected string").withColumn("coverage", F.lit("x")).withColumn("node", F.lit(0))
    got = {(r.train_id, r.test_id): r for r in C.cross_split_overlaps(df.union(df.limit(20))).collect()}
    sets = {r[0]: shingles(*r[3:]) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] == "test" and likeness(sets[a[0]], sets[b[0]]) >= 0.6}
    assert set(got) == want and (900, 901) in want
    for (a, b), r in got.items():
        assert r.likeness == pytest.approx(likeness(sets[a], sets[b])) and 0 < r.coverage <= 1
    report = {(r.split, r.source): r for r in C.overlap_report(df, *C.overlap_links(df)).collect()}
    assert report[("test", None)].overlapping + report[("test", "s")].overlapping == len({b for _, b in want})
    best = {r.id: r.coverage for r in C.best_coverage(*C.overlap_links(df)).collect()}
    assert best == {i: pytest.approx(max(r.coverage for (a, b), r in got.items() if i in (a, b))) for i in {i for p in want for i in p}}


def pairs_of(rows):
    sets = {r[0]: shingles(*r[2:]) for r in rows}
    return {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] == "test" and likeness(sets[a[0]], sets[b[0]]) >= 0.6}


@pytest.mark.parametrize("limits", [{}, {"HOT": 500, "SIDE": 16}, {"HOT_BATCH": 20, "SIDE": 64}])
def test_hot_seeds_lose_nothing(spark, monkeypatch, limits):
    """A phrase in every record and a third of all train records alike; by the task itself, by blocks, and by blocks from the maps on."""
    for name, value in limits.items():
        monkeypatch.setattr(C, name, value)
    rng = random.Random(4)
    phrase = text(rng, 20)
    base = [text(rng, 50) for _ in range(3)]
    rows = [(i, "train", *(f"{phrase} {edited(rng, b, 2)}" if i % 3 == 0 else f"{phrase} {text(rng, 50)}" for b in base)) for i in range(450)]
    rows += [(1000 + i, "test", *(f"{phrase} {edited(rng, b, 2)}" if i % 3 == 0 else f"{phrase} {text(rng, 50)}" for b in base)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, split string, prompt string, chosen string, rejected string")
    want = pairs_of(rows)
    got = {(r.train_id, r.test_id) for r in C.cross_split_overlaps(df).collect()}
    assert got == want and len(want) >= 150 * 20


def test_short_records_that_share_a_common_word_pair(spark):
    """No window is shared; "of the" is in all of them and is no seed of theirs."""
    rng = random.Random(11)
    short = lambda: f"{' '.join(rng.choice(VOCAB) for _ in range(6))} of the {' '.join(rng.choice(VOCAB) for _ in range(6))}"
    rows = [[i, "train", short(), short(), short()] for i in range(400)]
    for i in range(0, 400, 4):
        fields = [t.split() for t in rows[i][2:]]
        for w in fields:
            w[rng.randrange(6)] = rng.choice(VOCAB)
        rows.append([1000 + i, "test", *(" ".join(w) for w in fields)])
    rows += [[2000, "train", "of the", None, ""], [2001, "test", "Of the!", "", None]]
    df = spark.createDataFrame(rows, "sample_id long, split string, prompt string, chosen string, rejected string")
    want = pairs_of(rows)
    got = {(r.train_id, r.test_id) for r in C.cross_split_overlaps(df).collect()}
    assert got == want and len(want) > 80 and (2000, 2001) in want
    w = W.words([t for r in rows[:50] for t in r[2:]])
    p, f = W.pairs_of(w)
    record, pair = C._rare_pairs(w, p, f[::3], 0.6)
    assert W.pairs_of(W.words(["of the"]))[0][0] not in pair and len(np.unique(record)) == 50


def test_large_groups_of_edited_records_meet_by_every_seed():
    """All common seeds are frequent and no two successive ones need be common: each pair that shares a seed is still compared."""
    rng = random.Random(9)
    base = text(rng, 95)
    sides = [[" ".join(rng.choice(VOCAB) if rng.random() < 0.08 else x for x in base.split()) for _ in range(200)] for _ in range(2)]
    batch = pa.record_batch([pa.array(["train"] * 100 + ["test"] * 100), pa.array(sides[0][:100] + sides[1][:100])], ["split", "text"])
    other = pa.record_batch([pa.array(["train"] * 100 + ["test"] * 100), pa.array(sides[0][100:] + sides[1][100:])], ["split", "text"])
    (found,) = C._candidates(C._pack(iter([batch, other]), 1, "train", 1, 0.6), 1)
    got = set(zip(found["train"].to_pylist(), found["test"].to_pylist(), strict=True))
    seeds, sketches, nodes = [], [], []
    for t in sides[0] + sides[1]:
        r = C._seed_rows(W.words([t]), 1, 0.6)
        seeds.append(set(r[1].tolist()))
        nodes.append(int(r[-2].view(np.int64)[0]))
        sketches.append(r[-1][0])
    alike = lambda i, j: C._apart(sketches[i][None], sketches[j][None])[0] <= 128 - C.AGREE
    want = {(nodes[i], nodes[j]) for i in range(200) for j in range(200, 400) if seeds[i] & seeds[j] and alike(i, j)}
    assert got == want and len(want) > 10_000


def test_records_that_share_a_phrase_are_no_candidates():
    """Likeness about 0.3 by common phrases: such pairs grow with the square of the records, so nearly none may pass the sketch."""
    rng = random.Random(12)
    phrase = text(rng, 45)
    sides = [f"{phrase} {text(rng, 50)}" for _ in range(400)]
    batch = pa.record_batch([pa.array(["train"] * 200 + ["test"] * 200), pa.array(sides)], ["split", "text"])
    (found,) = C._candidates(C._pack(iter([batch]), 1, "train", 1, 0.6, 1000), 1)
    assert 0.25 < likeness(shingles(sides[0]), shingles(sides[1])) < 0.35
    assert found.num_rows < 0.002 * 200 * 200


def test_copies_from_many_batches_count_once():
    """Copies of two train and two test records: four pairs, however many copies, and no seed becomes hot by them."""
    rng = np.random.default_rng(6)
    rows = np.zeros(4, C.ROW)
    rows["node"], rows["sketch"] = np.arange(4), rng.integers(0, 2**63, rows["sketch"].shape[1]).astype(np.uint64)
    a, b = np.repeat(rows[:2], 40), np.repeat(rows[2:], 40)
    pairs, train, test = C._meet(a, b, np.zeros(0, np.uint32), 1000)
    assert pairs.tolist() == [[0, 2], [0, 3], [1, 2], [1, 3]] and not len(train) and not len(test)


def test_cross_split_without_rows(spark):
    empty = spark.createDataFrame([], "sample_id long, split string, prompt string, chosen string, rejected string")
    assert C.cross_split_overlaps(empty).count() == 0
