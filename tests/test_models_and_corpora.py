"""Model reports, corpora, metric tables, and ranks within skewed groups."""

import math
import statistics
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions import rollout
from prefloom.operators import generation as G
from prefloom.operators import metrics as M
from prefloom.operators import model_reports as R
from prefloom.operators import transforms as X
from prefloom.operators import validation as V
from prefloom.operators.ordered import exact_median, rank_within
from prefloom.session import cut, drop, small
from prefloom.sources import corpora as C

TASKS = "dataset_idx int, preference string"


@pytest.fixture(scope="module")
def three(spark):
    rows = [(10 * d + i, d, f"p{d} {i}", None if i == 1 else f"c {i}", "same") for d in (0, 1) for i in range(3)]
    return spark.createDataFrame(rows, "sample_id long, dataset_idx int, prompt string, chosen string, rejected string"), spark.createDataFrame([(0, "be brief"), (1, None), (2, "x")], TASKS)


def test_counts_clean_the_rendering_as_a_whole(samples):
    """The last word of a prompt carries a comma in the rendering, so it is no stop word there."""
    rows = samples([(0, 0, "train", "what boat is it", "c", "r"), (0, 1, "train", "what boat", "c", "r")])
    r = V.count_validation(rows, remove_stop_words=True).first()
    assert (r.unique_samples, r.unique_prompts) == (2, 1)


class Judge(G.HashClient):
    def __init__(self, replies):
        self.replies = replies

    def complete(self, request, schema, temperature, max_tokens):
        assert temperature == 0 and max_tokens == 7
        return self.replies[0] if "Alignment" in request else self.replies[1]


def test_judge_validation(three):
    s, t = three
    report, fresh = R.judge_validation(s, t, Judge(['{"score": 1}', '{"score": "12"}']), max_tokens=7, max_concurrency=3)
    got = {r.dataset_idx: r for r in report.collect()}
    assert got[0].alignment_mean == 1 and got[1].coherence_chosen_max == 10 and got[2].alignment_mean is None and len(got[0]) == 13
    again, none = R.judge_validation(s, t, Judge(["broken", "broken"]), cache=cut(fresh, "cache"), max_tokens=7, max_concurrency=3)
    assert again.collect() and none.count() == 0  # all from the cache
    bad, none = R.judge_validation(s, t, Judge(['{"score": 1}', "{}"]), max_tokens=7, max_concurrency=3)
    assert {(r.alignment_min, r.coherence_rejected_min) for r in bad.where("dataset_idx < 2").collect()} == {(1, None)}
    assert R.judge_validation(s, t, Judge(["x", "x"]), max_tokens=7, dry_run=True) is None
    with pytest.raises(G.RateLimited):
        R.judge_validation(s, t, Busy(), dry_run=True)
    assert R.judge_validation(s.limit(0), t, Judge(["x", "x"]), max_tokens=7)[0].count() == 3


class Busy(G.HashClient):
    def complete(self, *_):
        raise G.RateLimited


def test_embedding_validation(three):
    s, t = three
    report = R.embedding_validation(s, t, R.HashEmbedder(), batch_size=2, max_concurrency=3)
    got = {r.dataset_idx: r for r in report.collect()}
    assert len(report.columns) == 13 and got[0].rejected_max == pytest.approx(0, abs=1e-12) and all(v is None for v in got[2][1:])
    vectors = np.array(R.HashEmbedder().embed(["c 0", "", "c 2"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = 1 - (unit @ unit.sum(axis=0)) / 3
    assert [got[0][f"chosen_{k}"] for k in R.STATS] == pytest.approx([want.mean(), np.median(want), want.min(), want.max()])
    assert R.embedding_validation(s, t, R.HashEmbedder(), dry_run=True) is None
    with pytest.raises(ValueError):
        R.embed_texts(s, ["sample_id"], "prompt", R.HashEmbedder(), batch_size=0)
    assert R.embedding_validation(s.limit(0), t, R.HashEmbedder()).count() == 3


def test_requests_are_on_their_way_together(spark):
    """Several from each partition, never more than allowed."""
    assert G.in_flight(spark, 1) == (1, 1)
    parts, threads = G.in_flight(spark, 128)
    assert parts <= spark.sparkContext.defaultParallelism and parts * threads <= 128 and threads > 1
    busy, most, lock = [0], [0], threading.Lock()

    class Slow(G.HashClient):
        def complete(self, *a):
            with lock:
                busy[0] += 1
                most[0] = max(most[0], busy[0])
            time.sleep(0.02)
            with lock:
                busy[0] -= 1
            return super().complete(*a)

    import pyarrow as pa

    batch = pa.record_batch([pa.array([str(i) for i in range(40)]), pa.array([f"r{i}" for i in range(40)])], ["key", "query"])
    (out,) = G._run(iter([batch]), Slow(), "prompt", 1.0, 10, 1, 8)
    assert most[0] == 8 and out["result"].to_pylist() == [G.HashClient().complete(f"r{i}", "prompt", 1.0, 10) for i in range(40)]


def test_ranks_with_an_outlier_and_equal_values(spark):
    rows = [(1, i, float(i % 500)) for i in range(4000)] + [(1, -1, 1e13), (1, -2, -1e13), (None, 1, 5.0), (None, 2, None), (2, 1, 7.0)]
    df = spark.createDataFrame(rows, "g int, i long, v double")
    got = {(r.g, r.i): r.k for r in rank_within(df, ["g"], "v", ["i"], "k").collect()}
    for g in (1, 2, None):
        mine = sorted(((v is None, v or 0, i) for x, i, v in rows if x == g))
        assert [got[(g, i)] for _, _, i in mine] == list(range(1, len(mine) + 1))
    from prefloom.operators import ordered

    sizes = [r[0] for r in ordered._ranged(df.where("g = 1").withColumn("_pf_order", F.col("v")), ["g"], 64).groupBy("_pf_range").agg(F.count("*")).collect()]
    assert max(sizes) < 4000 / 20
    for values in ([1.0] * 999, [1.0] * 500 + [2.0] * 500, [3.0], [1e13] + [float(x) for x in range(100)]):
        one = spark.createDataFrame([(None, x) for x in values] + [(None, None)], "g int, v double")
        assert exact_median(one, ["g"], "v").first().median == statistics.median(values)


def test_advantages_are_linear_and_keep_nulls(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.25]), ([], []), (None, [1.0]), ([1.0] * 200_000, [0.0] * 200_000), ([1.0, 2.0], [1.0])], "r array<double>, v array<double>")
    out = [r.a for r in df.select(rollout.advantages(F.col("r"), F.col("v"), 0.5, 0.5).alias("a")).collect()]
    last = 2.0 - 0.25
    assert out[0] == pytest.approx([1.0 + 0.5 * 0.25 - 0.5 + 0.25 * last, last]) and out[1] == [] and out[2] is None and out[4][1] is None
    assert out[3][0] == pytest.approx(1 / (1 - 0.25)) and len(out[3]) == 200_000


def test_diversity_of_odd_vectors(spark):
    rows = [(0, None, [1.0, 0.0]), (1, None, [0.0, 2.0]), (2, 1, [0.0, 0.0]), (3, 1, [1.0]), (4, 2, None), (5, 2, [None, 3.0]), (6, 3, [])]
    df = spark.createDataFrame(rows, "i int, g int, e array<double>").withColumn("n", F.lit(1))
    got = {r.i: r.diversity for r in V.diversity(df, "e", ["g"]).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 1.0, 3: 0.5, 5: 0.0, 6: 1.0}
    assert V.diversity(df.limit(0), "e", ["g"]).count() == 0
    assert {r.g: r["max"] for r in V.diversity_report(df, "e", ["g"]).collect()} == {None: 0.5, 1: 1.0, 2: 0.0, 3: 1.0}


def test_slices_rank_only_what_they_touch(samples):
    df = samples([(d, i, "train", "p", "c", "r") for d in (3, 1, 7) for i in range(10)])
    got = lambda a, b: [(r.dataset_idx, r.sample_idx, r.global_idx) for r in X.take_slice(df, a, b).orderBy("global_idx").collect()]
    every = [(d, i, 10 * k + i) for k, d in enumerate((1, 3, 7)) for i in range(10)]
    for a, b in ((8, 12), (-3, None), (None, None), (0, 0), (25, 99), (12, 5)):
        assert got(a, b) == every[a:b]
    assert X.take_at(df, -1).first().dataset_idx == 7
    with pytest.raises(IndexError):
        X.take_at(df, 30)


def test_update_metrics(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0], [1.0, -1.0], [1.0], [0.0], [2.0])], "n array<double>, o array<double>, a array<double>, p array<double>, b array<double>, r array<double>")
    m = rollout.update_metrics(df, "n", "o", "a", "p", "b", "r", 0.2, 0.2).first()
    assert m.policy_loss == pytest.approx((-1 + math.e) / 2) and m.approx_kl == 0.25 and m.policy_clipped == 0 and m.value_clipped == 1
    assert m.value_loss == pytest.approx(0.5 * 1.8**2) and m.ratio_mean == pytest.approx((1 + math.e) / 2)


def test_corpora(spark, tmp_path):
    rows = [("train" if i % 3 else "test", i, ("see r/Relationships " if i % 2 else "") + f"p{i}", "a b c d e", "a b c d" if i == 7 else "f g h i j") for i in range(60)]
    rows += [("train", 100, None, "a b c d e", None), ("dev", 101, "p", "c", "r")]
    df = spark.createDataFrame(rows, "split string, row_idx long, prompt string, chosen string, rejected string")
    C.save_task_corpora(df, str(tmp_path / "t"), limits={"relationships": (5, 4, 2), "others": (100, 100, 0)})
    rl, reward = (C.load_task_corpora(spark, str(tmp_path / "t"), p) for p in ("rl", "reward"))
    pick = lambda x, d, s: sorted(r.row_idx for r in x.where((F.col("dataset_idx") == d) & (F.col("split") == s)).collect())
    assert pick(reward, 0, "train") == [1, 5, 11, 13] and pick(rl, 0, "train") == [1, 5, 7] and pick(rl, 0, "test") == [3, 9, 15, 21]
    assert 100 in pick(rl, 1, "train") and 100 not in pick(reward, 1, "train")
    with pytest.raises(ValueError):
        C.load_task_corpora(spark, str(tmp_path / "t"), "x")
    for name in ("ultrafeedback_binarized", "hh_rlhf"):
        spark.range(150).select(F.when(F.col("id") < 120, "train").otherwise("test").alias("split"), "id", F.col("id").alias("row_idx"), *(F.lit(name).alias(c) for c in ("prompt", "chosen", "rejected"))).write.parquet(str(tmp_path / name))
    paths = {n: str(tmp_path / n) for n in ("ultrafeedback_binarized", "hh_rlhf")}
    got = C.load_series(spark, "debug", paths)
    assert {(r.dataset_idx, r.split): r.n for r in got.groupBy("dataset_idx", "split").agg(F.count("*").alias("n")).collect()} == {(0, "train"): 100, (1, "train"): 20, (1, "test"): 30, (2, "train"): 100}
    for bad in (("x", paths), ("debug", {})):
        with pytest.raises(ValueError):
            C.load_series(spark, *bad)


def test_metric_table_and_scratch(spark, tmp_path):
    m = spark.createDataFrame([("loss", 1.0)], "key string, value double")
    for run in ("a", "b", "b"):
        M.append_metrics(m, str(tmp_path / "m"), run)
    assert {(r.run, r.n) for r in spark.read.parquet(str(tmp_path / "m")).groupBy("run").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("b", 2)}
    held = cut(m, "x")
    path = held.inputFiles()[0].removeprefix("file:")
    drop(held)
    drop(m)  # no scratch table
    assert not (tmp_path / path).exists()
    long = spark.createDataFrame([("x" * 5000,)] * 10, "s string")
    assert "broadcast" in small(long, limit=100_000)._jdf.queryExecution().logical().toString().lower() and "broadcast" not in small(long, limit=40_000)._jdf.queryExecution().logical().toString().lower()
