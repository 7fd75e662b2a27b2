import math

import pytest
from pyspark.sql import functions as F

from prefloom.operators import validation as V


def three(a, b, c):
    return [(0, i, "train", *(x.format("ABC"[i]) for x in (a, b, c))) for i in range(3)]


def test_counts_all_unique(samples):
    r = V.count_validation(samples(three("Mock prompt {} 1", "Winning Response {} 1", "Losing Response {} 1"))).first()
    assert (r.sample, r.unique_samples, r.unique_prompts, r.unique_chosen, r.unique_rejected) == (3, 3, 3, 3, 3)
    assert r.avg_prompt_length == r.avg_chosen_length == r.avg_rejected_length == 4.0


def test_counts_same(samples):
    r = V.count_validation(samples(three("Mock prompt A 2", "same", "same"))).first()
    assert (r.sample, r.unique_samples, r.unique_prompts, r.unique_chosen, r.unique_rejected) == (3, 1, 1, 1, 1)


def test_counts_stop_words_change_distinct_only(samples):
    rows = [(0, i, "train", *(f"{w} Mock {k} A 4" for k in ("prompt", "answer", "reply"))) for i, w in enumerate(("i", "be", "with"))]
    r = V.count_validation(samples(rows), remove_stop_words=True).first()
    assert (r.sample, r.unique_samples, r.unique_prompts, r.avg_prompt_length) == (3, 1, 1, 5.0)


def test_counts_rendering_is_identity(samples):
    rows = [(0, 0, "train", "a, Chosen: b", "c", "d"), (0, 1, "train", "a", "b, Chosen: c", "d")]
    r = V.count_validation(samples(rows)).first()
    assert (r.unique_samples, r.unique_prompts) == (1, 2)


def test_counts_empty_dataset_null_texts_and_repeats(spark, samples):
    tasks = spark.createDataFrame([(0,), (1,)], "dataset_idx int")
    rows = samples([(0, 0, "train", None, "", "x y"), (0, 0, "train", None, "", "x y")]).withColumn("id", F.lit(1))
    out = {r.dataset_idx: r for r in V.count_validation(rows, tasks, key="id").collect()}
    assert out[0].sample == 1 and out[0].avg_prompt_length == 0 and out[0].avg_rejected_length == 2
    assert out[1].sample == 0 and out[1].unique_prompts == 0
    assert V.count_validation(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (three("Mock prompt {} 1", "Mock prompt {} 1", "Mock prompt {} 1"), 1.660947433286918),
        (three("Mock prompt A 2", "Mock prompt A 2", "Mock prompt A 2"), 1.3862943611198906),
        (three("foo foo foo", "foo foo foo", "foo foo foo"), 0.0),
    ],
)
def test_entropy(samples, rows, want):
    r = V.entropy_validation(samples(rows)).first()
    for v in (r.prompt_entropy, r.chosen_entropy, r.rejected_entropy):
        assert math.isclose(v, want, abs_tol=1e-12)


def test_entropy_stop_words_and_empty(spark, samples):
    rows = [(0, i, "train", *(f"{w} Mock prompt A 4" for _ in range(3))) for i, w in enumerate(("i", "be", "with"))]
    tasks = spark.createDataFrame([(0,), (7,)], "dataset_idx int")
    out = {r.dataset_idx: r.prompt_entropy for r in V.entropy_validation(samples(rows), tasks, True).collect()}
    # Mock, prompt, 4 (A is a stop word)
    assert math.isclose(out[0], 1.0986122886681096) and out[7] == 0.0


def test_diversity_matches_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    x[3] = 0
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "id int, g int, e array<double>")
    got = {r.id: r.diversity for r in V.diversity(df, "e", ["g"]).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    for i in range(20):
        same = u[[j for j in range(20) if j % 2 == i % 2]]
        assert math.isclose(got[i], 1 - float((same @ u[i]).mean()), abs_tol=1e-12)
    assert got[3] == 1.0


def test_judge_scores_are_clamped_and_null_for_empty(spark, samples):
    s = spark.createDataFrame([(i, 0) for i in range(6)] + [(9, 1)], "sample_id long, dataset_idx int")
    scores = spark.createDataFrame([(i, "alignment", v, i) for i, v in enumerate((-1, 0, 1, 5, 10, 12))] + [(0, "alignment", None, 99)], "sample_id long, metric string, score int, score_id long").withColumn("judged_at", F.lit(0))
    r = {x.dataset_idx: x for x in V.judge_report(s, V.latest_scores(scores)).collect()}
    assert (r[0].alignment_min, r[0].alignment_max, r[0].alignment_median) == (0, 10, 3.0)
    assert math.isclose(r[0].alignment_mean, 26 / 6) and r[0].coherence_chosen_mean is None and r[1].alignment_mean is None
    c = {(x.dataset_idx, x.metric): x.coverage for x in V.judge_coverage(s, V.latest_scores(scores)).collect()}
    assert c[(0, "alignment")] == 1.0 and c[(1, "alignment")] == 0.0
