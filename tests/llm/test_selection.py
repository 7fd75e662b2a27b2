"""Varied subsets and packing."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.llm import packing as P
from prefloom.llm import varied_subset as S

DOMAIN = "dataset_idx int, domain map<string, struct<name: string, seed_words: array<string>, description: string, weight: double>>"


def tables(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(600)]
    seeds = ["anchor", "Keel", "hull", "tide", "rare"]
    rows = []
    for i in range(600):
        if i % 3 == 0:  # a third of all rows are nearly one prompt
            t = "tell me of the anchor and the tide near the old pier " + rng.choice(vocab)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(12)) + " " + rng.choice(seeds[:4])
        rows.append((i, i % 2, t))
    rows[17] = (17, 1, "one rare word")
    rows += [(700, 0, None), (None, 0, "no id"), (5, 1, rows[5][2])]
    samples = spark.createDataFrame(rows, "sample_id long, dataset_idx int, prompt string").withColumn("distance", F.lit(0)).withColumn("grp", F.lit(0))
    tasks = spark.createDataFrame([(0, {"a": ("a", [*seeds, None], None, None)})], DOMAIN)
    requests = spark.createDataFrame([(1, 0, 10), (2, None, 30), (3, None, 10), (4, 1, 100_000), (5, 9, 5), (6, 0, None), (7, 0, 0)], "request_id int, dataset_idx int, subset_size int")
    return samples, requests, tasks


def test_subsets(spark, monkeypatch):
    samples, requests, tasks = tables(spark)
    out = S.varied_subsets(samples.repartition(4), requests, tasks).collect()
    n = Counter(r.request_id for r in out)
    assert n == {1: 10, 2: 30, 3: 10, 4: 300}
    by = {k: [r.sample_id for r in sorted(out, key=lambda r: r.place) if r.request_id == k] for k in n}
    assert all(len(set(v)) == len(v) for v in by.values()) and by[3] == by[2][:10]
    assert 17 in by[3]  # the rare seed word
    assert sum(i % 3 == 0 for i in by[2]) <= 6  # a third of the rows, at most a fifth of the choice
    everything = sorted((r for r in out if r.request_id == 4), key=lambda r: r.place)
    assert [r.sample_id for r in everything] == sorted(r.sample_id for r in everything) and {r.distance for r in everything} == {None}
    monkeypatch.setattr(S, "BLOCK", 100)
    some = [{tuple(r) for r in S.varied_subsets(samples.repartition(k), requests, tasks).collect()} for k in (1, 7)]
    assert some[0] == some[1]  # however the rows are partitioned
    far = [r.distance for r in sorted(out, key=lambda r: r.place) if r.request_id == 2]
    assert far[0] is None and all(d > 0 for d in far[1:])


def test_seed_words_are_covered_first():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).astype(np.float32) * 0.1
    held = [np.array([rng.integers(0, 3)] if i != 77 else [3, 4], dtype=np.int32) for i in range(500)]
    at, _ = S.farthest_first(np.arange(500), x, 4, held, np.ones(5, np.float32))
    assert at[0] == 77 and {int(w) for i in at for w in held[i]} == {0, 1, 2, 3, 4}


def test_blocks_cost_little_cover(spark, monkeypatch):
    """Selection in blocks covers within the known factor of the selection in one block."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    ids = np.arange(4000)

    def radius(chosen):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(-1).min(1)
        return float(np.sqrt(d.max()))

    one = S.farthest_first(ids, x, 20)[0]
    pool = np.concatenate([b[S.farthest_first(ids[b], x[b], 20)[0]] for b in np.array_split(ids, 8)])
    two = pool[S.farthest_first(ids[pool], x[pool], 20)[0]]
    assert radius(two) <= 2 * radius(one)


def test_subsets_of_nothing(spark):
    samples, requests, tasks = tables(spark)
    assert S.varied_subsets(samples.limit(0), requests, tasks).count() == 0
    assert S.varied_subsets(samples, requests.limit(0), tasks).count() == 0
    assert S.varied_subsets(samples, requests.where("request_id = 1"), tasks.limit(0)).count() == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_plan_holds_every_length_within_capacity(lengths):
    have = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    patterns = P.plan(have, 64)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 64 and n > 0
        for length, m in Counter(p).items():
            used[length] += n * m
    assert used == Counter(lengths)
    assert sum(n for _, n in patterns) <= len(lengths)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(1024, (rng.lognormal(5, 1, 5000)).astype(int) + 1)
    have = np.bincount(lengths, minlength=1025)
    n = sum(n for _, n in P.plan(have, 1024))
    assert n <= 1.01 * np.ceil(lengths.sum() / 1024)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(1, 200)) for i in range(900)] + [(1000, 0), (1001, 130)]
    sizes = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("piece", F.lit(5))
    packs = spark.createDataFrame([(1, 64), (2, 256), (3, None), (None, 9)], "pack_id int, capacity_tokens int")
    out = P.pack(sizes.repartition(5), packs, "doc_id", salts=4).collect()
    for pack_id, cap in ((1, 64), (2, 256)):
        mine = [r for r in out if r.pack_id == pack_id]
        fill, whole = Counter(), Counter()
        for r in mine:
            fill[r.container_id] += r.tokens
            whole[r.doc_id] += r.tokens
        assert max(fill.values()) <= cap and sorted(fill) == list(range(1, len(fill) + 1))
        assert whole == Counter({i: n for i, n in rows if n})
        assert len({(r.doc_id, r.piece) for r in mine}) == len(mine)
        pieces = Counter(r.doc_id for r in mine)
        assert all(pieces[i] == -(-n // cap) for i, n in rows if n)
        assert len(fill) <= 1.03 * np.ceil(sum(n for _, n in rows) / cap)
    report = {r.pack_id: r for r in P.packing_report(P.pack(sizes, packs, "doc_id"), packs).collect()}
    assert report[1].unused == report[1].containers * 64 - report[1].tokens and report[1].containers >= report[1].least
    assert P.pack(sizes.limit(0), packs, "doc_id").count() == 0 and P.pack(sizes, packs.limit(0), "doc_id").count() == 0


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    path = P.TOKENIZER.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Hello, world's end 42!", "", None, "Der Fluß\n\n  и мост 🙂 <|endoftext|>", "a" * 2000]
    df = spark.createDataFrame([*enumerate(texts), (None, "x")], "doc_id long, text string").withColumn("tokens", F.lit("x"))
    got = {r.doc_id: r.tokens for r in P.token_counts(df, "doc_id", "text").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for i, x in enumerate(texts)}
