import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions import chat, preference, rollout, text
from prefloom.functions.rng import hash_uniform


def one(spark, col, row=None, schema=None):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_tokens_split_on_all_unicode_spaces(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    s = "a" + "b".join(spaces) + "c"
    assert one(spark, text.tokens("t"), (s,), "t string") == s.split()
    assert one(spark, text.tokens("t"), (None,), "t string") == []


def test_stop_words(spark):
    assert len(text.STOP_WORDS) == 179
    assert one(spark, text.without_stop_words("t"), ("The cat  IS not On a mat",), "t string") == "cat mat"


def test_names_and_keys(spark):
    import hashlib

    assert one(spark, text.clean_dataset_name(F.lit("hub/some/name.v1.json/"))) == "name"
    assert one(spark, text.cache_key(F.lit("q"), F.lit("3"))) == hashlib.sha256(b"q\n3").hexdigest()
    assert one(spark, text.cache_key(F.lit("q"), F.lit(None).cast("string"))) == hashlib.sha256(b"q").hexdigest()
    assert text.cache_index_name("Org/Model") == "org_model"


def test_uniform(spark):
    u = [r.u for r in spark.range(4000).select(hash_uniform(1, "id").alias("u")).collect()]
    assert all(0 <= x < 1 for x in u) and abs(np.mean(u) - 0.5) < 0.02 and abs(np.var(u) - 1 / 12) < 0.01


ARR = "r array<double>, v array<double>"


def test_advantages(spark):
    r, v = [1.0, -0.5, 2.0], [0.3, 0.1, 0.7]
    got = one(spark, rollout.advantages(F.col("r"), F.col("v"), 0.9, 0.8), (r, v), ARR)
    want, last = [], 0.0
    for t in (2, 1, 0):
        last = r[t] + 0.9 * (v[t + 1] if t < 2 else 0) - v[t] + 0.72 * last
        want.insert(0, last)
    assert np.allclose(got, want)
    assert one(spark, rollout.advantages(F.col("r"), F.col("v"), 0.9, 0.8), ([], []), ARR) == []
    assert one(spark, rollout.advantages(F.col("r"), F.col("v"), 0.9, 0.8), (None, None), ARR) is None


@pytest.mark.parametrize(("length", "want"), [(0, [0.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0])])
def test_terminal_score(spark, length, want):
    assert one(spark, rollout.add_terminal_score(F.array(*(F.lit(0.0),) * 3), F.lit(length), F.lit(1.0))) == want


def test_masks_and_truncation(spark):
    a = F.array(*(F.lit(float(i)) for i in range(4)))
    assert one(spark, rollout.mask_after(a, F.lit(1), 9.0)) == [0.0, 1.0, 9.0, 9.0]
    assert one(spark, rollout.mask_after(a, F.lit(1), 0.0, 1)) == [0.0, 1.0, 2.0, 0.0]
    t = F.array(*(F.lit(i) for i in (5, 7, 6, 7)))
    assert one(spark, rollout.truncate_response(t, 7, -1)) == [5, 7, -1, -1]
    assert one(spark, rollout.truncate_response(t, 8, -1)) == [5, 7, 6, 7]
    assert one(spark, rollout.missing_eos_penalty(F.lit(1.0), t, 8, 0.5)) == 0.5


def test_plasticity(spark):
    p = rollout.plasticity(F.col("l"), F.col("r"), F.col("m"))
    schema = "l array<double>, r array<double>, m array<boolean>"
    for l, r, m, want in (
        ([5.0, 5.0, 0.0], [0.0, 9.0, 0.0], [True, True, False], (2.0, 2.0)),
        ([0.0, 0.0, 5.0], [0.0, 9.0, 0.0], [True, True, False], (2.0, 0.2)),
        ([5.0, 5.0, 0.0], [9.0, 0.0, 9.0], [True, True, False], (2.0, 0.2)),
        ([0.0, 0.0, 5.0], [9.0, 0.0, 9.0], [True, True, False], (0.2, 0.2)),
        ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0], [True, True, False], (1.0, 1.0)),
        ([1.0], [1.0], [False], (1.0, 1.0)),
    ):
        x = one(spark, p, (l, r, m), schema)
        assert (x.learn, x.reg) == want


def test_whiten(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(3, 2, 5)], int(rng.integers(0, 5))) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, a array<double>, n int")
    inside = [x for _, a, n in rows for x in a[: n + 1]]
    m, v = np.mean(inside), np.var(inside, ddof=1)
    for shift in (True, False):
        for r in rollout.whiten(df, "a", "n", "w", shift).collect():
            want = [(x - m) / math.sqrt(v + 1e-8) + (0 if shift else m) if i <= r.n else 0 for i, x in enumerate(r.a)]
            assert np.allclose(r.w, want)


def test_losses(spark):
    assert math.isclose(one(spark, preference.pair_loss(F.lit(2.0), F.lit(1.0))), math.log(1 + math.exp(-1)))
    assert one(spark, preference.pair_loss(F.lit(-1000.0), F.lit(0.0))) == 1000.0
    s = one(spark, preference.reward_softmax(F.lit(1.0), F.lit(0.0)))
    assert math.isclose(s.chosen, math.e / (math.e + 1)) and math.isclose(s.chosen + s.rejected, 1)
    s = one(spark, preference.reward_softmax(F.lit(None).cast("double"), F.lit(0.0)))
    assert (s.chosen, s.rejected) == (0.9, 0.1)


def test_policy_losses(spark):
    p = rollout.policy_losses(F.array(F.lit(1.0)), F.array(F.lit(0.0)), F.array(F.lit(2.0)), 0.2)
    x = one(spark, p)[0]
    assert math.isclose(x.loss, -2.4) and x.clipped
    v = one(spark, rollout.value_losses(F.array(F.lit(2.0)), F.array(F.lit(0.0)), F.array(F.lit(1.5)), 0.5))[0]
    assert math.isclose(v, 0.5)


MSG = "c array<struct<role: string, content: string>>, r array<struct<role: string, content: string>>"


def test_extract_prompt(spark):
    u, a, b = ("user", "hi"), ("assistant", "x"), ("assistant", "y")
    got = one(spark, chat.extract_prompt(F.col("c"), F.col("r")), ([u, a], [u, b]), MSG)
    assert [len(got.prompt), len(got.chosen), len(got.rejected)] == [1, 1, 1]
    got = one(spark, chat.extract_prompt(F.col("c"), F.col("r")), ([u, a], [u, a]), MSG)
    assert [len(got.prompt), len(got.chosen)] == [2, 0]


def test_chat_template(spark):
    text_ = one(spark, chat.apply_chat_template(F.col("c"), "<e>", True), ([("user", "hi"), ("assistant", "yo")], []), MSG)
    assert "<|user|>\nhi" in text_ and "<|assistant|>\nyo<e>" in text_ and text_.startswith("<e>") and text_.count("<|assistant|>") == 2
