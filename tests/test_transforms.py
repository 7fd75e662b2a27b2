import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.operators import transforms as X
from prefloom.operators.ordered import exact_median, rank_within


def rows(n, dataset=0, split="train"):
    return [(dataset, i, split, f"p{i}", f"c{i}", f"r{i}") for i in range(n)]


@pytest.mark.parametrize(("ratio", "n", "train"), [(0.5, 3, 1), (0.3, 90, 62), (0.0, 4, 4), (1.0, 4, 0)])
def test_split(samples, ratio, n, train):
    out = X.split(samples(rows(n)).drop("split"), ratio)
    assert out.where("split = 'train'").count() == train
    assert sorted(r.sample_idx for r in out.where("split = 'train'").collect()) == list(range(train))


def test_split_needs_an_empty_test_split(samples):
    with pytest.raises(ValueError):
        X.split(samples(rows(2, split="test")), 0.5)
    for bad in (-1, 2):
        with pytest.raises(ValueError):
            X.split(samples(rows(2)), bad)
        with pytest.raises(ValueError):
            X.PreferenceSwap(bad)


def test_swap(samples):
    s = samples(rows(400))
    assert X.preference_swap(s, 0).collect() == s.collect()
    assert all(r.chosen == f"r{r.sample_idx}" for r in X.preference_swap(s, 1).collect())
    half = X.preference_swap(s, 0.5, 3)
    swapped = {r.sample_idx for r in half.collect() if r.chosen.startswith("r")}
    assert abs(len(swapped) - 200) < 50
    for k in (1, 7):
        assert {r.sample_idx for r in X.preference_swap(s.repartition(k), 0.5, 3).collect() if r.chosen.startswith("r")} == swapped
    assert {r.sample_idx for r in X.PreferenceSwap(0.5, 4)(s).collect() if r.chosen.startswith("r")} != swapped


def test_stored_fraction_moves_the_boundary(samples):
    s = samples([(0, i, "train" if i < 15 else "test", "p", "c", "r") for i in range(22)])
    assert int(15 / 22 * 22) == 14
    assert X.resplit_compatible(s).where("split = 'train'").count() == 14


def test_slices(samples):
    s = samples(rows(3, 0) + rows(3, 1) + rows(3, 2))
    pick = lambda df: [(r.dataset_idx, r.sample_idx) for r in df.orderBy("global_idx").collect()]
    every = [(d, i) for d in range(3) for i in range(3)]
    for a, b in ((1, 2), (2, 7), (None, None), (-4, -1), (5, 100)):
        assert pick(X.take_slice(s, a, b)) == every[a:b]
    assert pick(X.take_at(s, 0)) == every[:1] and pick(X.take_at(s, -1)) == every[-1:]
    with pytest.raises(IndexError):
        X.take_at(s, 9)


def test_merge_and_append(samples):
    a, b = samples(rows(2, 0) + rows(1, 1)), samples(rows(3, 0))
    out = X.merge(a, b)
    assert sorted((r.dataset_idx, r["count"]) for r in out.groupBy("dataset_idx").count().collect()) == [(0, 2), (1, 1), (2, 3)]
    assert X.append(a.limit(0), b).count() == 3
    with pytest.raises(TypeError):
        X.append(a, a.select("prompt"))


def test_stratified_sample(samples):
    s = samples(rows(90, 0) + rows(10, 0, "test") + rows(5, 1))
    out = X.stratified_sample(s, 0.7, 0.5, seed=1)
    got = {(r.dataset_idx, r.split): r["count"] for r in out.groupBy("dataset_idx", "split").count().collect()}
    assert got == {(0, "train"): int(0.7 * 90), (0, "test"): 5, (1, "train"): 3}
    assert X.stratified_sample(s, 1.0, 1.0, 1000, 2).where("dataset_idx = 0").groupBy("split").count().collect()
    a = {tuple(r) for r in out.select("dataset_idx", "sample_idx", "split").collect()}
    assert a == {tuple(r) for r in X.stratified_sample(s.repartition(7), 0.7, 0.5, seed=1).select("dataset_idx", "sample_idx", "split").collect()}


def test_filters(samples):
    s = samples([(0, 0, "train", "r/Relationships x", "a b c d e", "a b c d f"), (0, 1, "train", None, "a b c d e", "a b c d e"), (0, 2, "train", "p", "a b", "a b c d e"), (0, 3, "train", "p", None, "a b c d e")])
    assert [r.sample_idx for r in X.quality_filter(s).collect()] == [0]
    assert [r.sample_idx for r in X.category_filter(s, "relationships").collect()] == [0]
    assert X.category_filter(s, "others").count() == 3


def test_batches_and_minibatches(samples):
    s = samples(rows(10))
    assert sorted(r["count"] for r in X.in_batches(s, 4).groupBy("batch").count().collect()) == [2, 4, 4]
    assert X.in_batches(s, 4, drop_last=True).count() == 8
    m = X.minibatches(s, 4, 1)
    assert m.count() == 8 and sorted(r.place for r in m.collect()) == list(range(8))


def test_replay_buffer(samples):
    s = samples(rows(100, 0) + rows(50, 1) + rows(3, 2))
    out = X.replay_buffer(s, ratio=0.1, capacity=12, seed=0)
    n = {r.after: r["count"] for r in out.groupBy("after").count().collect()}
    assert n == {0: 10, 1: 12, 2: 12}
    assert X.replay_buffer(s.limit(0), ratio=0.1).count() == 0


def test_replay_buffer_query_folds_every_dataset(spark, sf_dir):
    """The registered query against a fold in plain Python, over all datasets of the tables."""
    from prefloom.functions.rng import hash_uniform
    from prefloom.plans.queries import QUERIES
    from prefloom.plans.views import samples as view

    s = view(spark, sf_dir, "dataset_idx", "sample_idx", "split").where("split = 'train'")
    steps = sorted(r[0] for r in s.select("dataset_idx").distinct().collect())
    draws = {f"k{t}": hash_uniform(f"4-keep-{t}", "dataset_idx", "sample_idx") for t in steps}
    rows = s.select("dataset_idx", "sample_idx", hash_uniform("4-add", "dataset_idx", "sample_idx").alias("add"), *(c.alias(n) for n, c in draws.items())).collect()
    want, held = set(), []
    for t in steps:
        mine = sorted((r for r in rows if r.dataset_idx == t), key=lambda r: (r["add"], r.sample_idx))
        held += mine[: max(1, int(len(mine) * 0.1))]
        held = sorted(held, key=lambda r: (r[f"k{t}"], r.dataset_idx, r.sample_idx))[:60]
        want |= {(r.dataset_idx, r.sample_idx, t) for r in held}
    got = [(r.dataset_idx, r.sample_idx, r["after"]) for r in QUERIES["replay_buffer"](spark, sf_dir).collect()]
    assert set(got) == want and len(got) == len(want) and max(steps) > 8


def test_verdicts(spark, samples):
    s = samples(rows(4))
    scores = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.5)], "dataset_idx int, sample_idx long, score double")
    assert {r.sample_idx for r in X.swap_by_verdict(s, scores).collect() if r.chosen.startswith("r")} == {0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-50, 50))), max_size=60))
def test_ranks_match_a_plain_sort(spark, data):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g int, v int, i int")
    got = {r.i: r.rank for r in rank_within(df, ["g"], "v", ["i"], ranges=5).collect()}
    for g in range(3):
        mine = sorted((i for i, (h, _) in enumerate(data) if h == g), key=lambda i: (data[i][1] is None, data[i][1] or 0, i))
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))


def test_hot_group_is_cut(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.lit(1)))
    out = rank_within(df, ["g"], "id", ["id"])
    assert out.groupBy("g").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("n")).where("m <> n").count() == 0
    assert math.isclose(out.where("g = 0").count(), 1000)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-9, 9)), min_size=1, max_size=40))
def test_exact_median(spark, data):
    import statistics

    df = spark.createDataFrame([(g, float(v)) for g, v in data] + [(0, None)], "g int, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(v for h, v in data if h == g) for g in {g for g, _ in data}}
