"""Arithmetic on rollouts: one row for each rollout, one array for each quantity.

Arrays are folded with higher-order functions, so a rollout never leaves its row.  Null arrays
give null; empty arrays give empty arrays or zero sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what masked log-probabilities are set to.
INVALID_LOGPROB = 1.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a))


def array_std(a: Column) -> Column:
    """Sample deviation (one degree of freedom less); null under two values."""
    m = array_mean(a)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / (F.size(a) - 1)))


def missing_eos_penalty(score: Column, response: Column, eos: int, penalty: float) -> Column:
    """The score, less the penalty if the response never ends."""
    return F.when(F.array_contains(response, eos), score).otherwise(score - F.lit(penalty))


def truncate_response(response: Column, stop: int, pad: int) -> Column:
    """Everything after the first stop token becomes padding."""
    at = F.array_position(response, stop)
    return F.transform(response, lambda x, i: F.when((at > 0) & (i >= at), F.lit(pad)).otherwise(x))


def mask_after(a: Column, length: Column, fill: float, extra: int = 0) -> Column:
    """Places beyond ``length + extra`` (counted from 0) become ``fill``."""
    return F.transform(a, lambda x, i: F.when(i > length + F.lit(extra), F.lit(fill)).otherwise(x))


def kl(logprobs: Column, ref: Column) -> Column:
    return F.zip_with(logprobs, ref, lambda a, b: a - b)


def non_score_reward(logprobs: Column, ref: Column, coef: float) -> Column:
    return F.zip_with(logprobs, ref, lambda a, b: (a - b) * F.lit(-coef))


def add_terminal_score(rewards: Column, length: Column, score: Column) -> Column:
    """Add the score one place after the last token, or at it if the array ends there."""
    end = F.when(length + 1 < F.size(rewards), length + 1).otherwise(length)
    return F.transform(rewards, lambda x, i: F.when(i == end, x + score).otherwise(x))


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates: A_t = d_t + gamma lam A_{t+1}, d_t = r_t + gamma V_{t+1} - V_t, nothing after the end.

    A recurrence over the places of an array: folds of built-in functions copy their array at each step, so this is an Arrow
    batch function whose time is linear in the places.  A place that only one of the arrays has is null.
    """

    def estimate(r: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(r, v, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
            n = max(len(a), len(b))
            a, b = (np.append(x, np.full(n - len(x), np.nan)) for x in (a, b))
            delta = a + gamma * np.append(b[1:], 0.0) - b
            gae = 0.0
            result = []
            for d in delta[::-1].tolist():
                gae = d + gamma * lam * gae
                result.append(gae)
            out.append([None if x != x else x for x in result[::-1]])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(estimate, "array<double>")(rewards, values)


def returns(adv: Column, values: Column) -> Column:
    return F.zip_with(adv, values, lambda a, v: a + v)


def whiten(df: DataFrame, array: str, length: str, out: str, shift_mean: bool = True, extra: int = 0, batch: list[str] | None = None) -> DataFrame:
    """Scale the unmasked values of a whole batch to deviation one (and mean zero), masked places to zero.

    The batch is the table, or each group of ``batch`` columns; its moments are partially aggregated (mean, and the
    unbiased variance) and joined back, so no batch is gathered in one task.
    """
    inside = F.filter(F.transform(F.col(array), lambda x, i: F.when(i <= F.col(length) + F.lit(extra), x)), lambda x: x.isNotNull())
    moments = df.select(*(batch or []), F.explode(inside).alias("x")).groupBy(*(batch or [])).agg(F.avg("x").alias("_pf_mean"), F.var_samp("x").alias("_pf_var"))
    if batch:
        joined, mean, var = df.join(moments, batch), F.col("_pf_mean"), F.col("_pf_var")
    else:
        one = moments.first()  # two numbers
        joined, mean, var = df, F.lit(one[0]), F.lit(one[1])
    scaled = lambda x: (x - mean) / F.sqrt(var + F.lit(1e-8)) + (F.lit(0.0) if shift_mean else mean)
    value = F.transform(F.col(array), lambda x, i: F.when(i <= F.col(length) + F.lit(extra), scaled(x)).otherwise(F.lit(0.0)))
    return joined.withColumn(out, value).drop("_pf_mean", "_pf_var")


def plasticity(logprobs: Column, rewards: Column, mask: Column, threshold: float = 0.5, upper: float = 2.0, lower: float = 0.2) -> Column:
    """struct(learn, reg): both weights follow from where the last reward and the mean log-probability lie around their means."""
    n = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    last = F.try_element_at(rewards, F.when(n > 0, n).otherwise(F.lit(-1)))
    lp = F.aggregate(F.zip_with(logprobs, mask, lambda x, m: x * m.cast("int")), F.lit(0.0), lambda acc, x: acc + x) / F.when(n > 0, n)
    lm, ls = array_mean(logprobs), array_std(logprobs)
    rm, rs = array_mean(rewards), array_std(rewards)
    t = F.lit(threshold)
    high_r, low_r = last > rm + t * rs, last < rm - t * rs
    high_p, low_p = lp > lm + t * ls, lp < lm - t * ls
    up, lo, one = F.lit(upper), F.lit(lower), F.lit(1.0)
    learn = F.when(high_r & (high_p | low_p), up).when(low_r & high_p, up).when(low_r & low_p, lo).otherwise(one)
    reg = F.when(high_r & high_p, up).when((high_r & low_p) | (low_r & (high_p | low_p)), lo).otherwise(one)
    return F.struct(learn.alias("learn"), reg.alias("reg"))


def objective_metrics(df: DataFrame, logprobs: str, ref: str, score: str, coef: float, responses: str | None = None, eos: int | None = None) -> DataFrame:
    """One row: mean KL, entropy, non-score reward, score and total reward of the batch, and its end tokens."""
    k = _sum(kl(F.col(logprobs), F.col(ref)))
    out = [
        F.avg(k).alias("kl"),
        F.avg(-_sum(F.col(logprobs))).alias("entropy"),
        F.avg(k * F.lit(-coef)).alias("non_score_reward"),
        F.avg(score).alias("scores"),
        (F.avg(k * F.lit(-coef)) + F.avg(score)).alias("rlhf_reward"),
    ]
    if responses is not None and eos is not None:
        out.append(F.sum(F.size(F.filter(F.col(responses), lambda x: x == eos))).alias("num_eos_tokens"))
    return df.agg(*out)


def policy_losses(new: Column, old: Column, adv: Column, clip: float) -> Column:
    """Per-place struct(ratio, loss, clipped): the clipped policy loss of each token."""

    def one(d: Column, a: Column) -> Column:
        ratio = F.exp(d)
        plain, bound = -a * ratio, -a * F.greatest(F.lit(1.0 - clip), F.least(F.lit(1.0 + clip), ratio))
        return F.struct(ratio.alias("ratio"), F.greatest(plain, bound).alias("loss"), (bound > plain).alias("clipped"))

    return F.zip_with(F.zip_with(new, old, lambda a, b: a - b), adv, one)


def value_losses(pred: Column, old: Column, ret: Column, clip: float) -> Column:
    """Per-place half squared error, the worse of the plain and the clipped prediction."""
    pairs = F.zip_with(old, ret, lambda o, r: F.struct(o.alias("o"), r.alias("r")))

    def one(p: Column, x: Column) -> Column:
        bound = F.greatest(x["o"] - F.lit(clip), F.least(x["o"] + F.lit(clip), p))
        return F.lit(0.5) * F.greatest((p - x["r"]) * (p - x["r"]), (bound - x["r"]) * (bound - x["r"]))

    return F.zip_with(pred, pairs, one)


def update_metrics(df: DataFrame, new: str, old: str, adv: str, pred: str, before: str, ret: str, clip: float, clip_value: float) -> DataFrame:
    """One row for a batch of updates, over all places: mean policy and value loss, approximate KL, share of clipped
    policy places and of value places whose clipped prediction is the worse one, and mean and variance of the probability ratio.

    The policy arrays (``new``, ``old``, ``adv``) have the same places, as have the value arrays (``pred``, ``before``, ``ret``).
    An empty batch has nulls.
    """
    policy = policy_losses(F.col(new), F.col(old), F.col(adv), clip)
    gap = F.zip_with(F.col(new), F.col(old), lambda a, b: F.lit(0.5) * (a - b) * (a - b))
    plain = F.zip_with(F.col(pred), F.col(ret), lambda p, r: F.lit(0.5) * (p - r) * (p - r))
    worse = value_losses(F.col(pred), F.col(before), F.col(ret), clip_value)
    both = F.arrays_zip(policy.alias("p"), gap.alias("k"), worse.alias("v"), plain.alias("q"))
    x = df.select(F.explode(both).alias("x")).select("x.p.*", F.col("x.k").alias("k"), F.col("x.v").alias("v"), F.col("x.q").alias("q"))
    return x.agg(
        F.avg("loss").alias("policy_loss"), F.avg("v").alias("value_loss"), F.avg("k").alias("approx_kl"), F.avg(F.col("clipped").cast("double")).alias("policy_clipped"),
        F.avg((F.col("v") > F.col("q")).cast("double")).alias("value_clipped"), F.avg("ratio").alias("ratio_mean"), F.var_samp("ratio").alias("ratio_var"),
    )
