"""Preference losses over tables of log-probabilities and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_sigmoid(x: Column) -> Column:
    """ln(1 / (1 + e^-x)), without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def pair_loss(chosen: Column, rejected: Column) -> Column:
    """-ln sigmoid(chosen - rejected)."""
    return -log_sigmoid(chosen - rejected)


def reward_softmax(chosen: Column, rejected: Column) -> Column:
    """struct(chosen, rejected): probabilities of both rewards; 0.9 and 0.1 where a reward is missing."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(rejected - chosen))
    known = chosen.isNotNull() & rejected.isNotNull()
    return F.struct(F.when(known, p).otherwise(F.lit(0.9)).alias("chosen"), F.when(known, F.lit(1.0) - p).otherwise(F.lit(0.1)).alias("rejected"))


def constrained_loss(df: DataFrame, is_new: str, lam: float, threshold: float = 0.1, rate: float = 1e-4, coef: float = 0.8) -> DataFrame:
    """One row with the losses of a batch of new and replayed pairs, and the multiplier's change.

    ``df`` has chosen, rejected and their references (ref_chosen, ref_rejected) as log-probabilities.  New rows give the
    fitting loss, replayed ones the regularisation (1e-9 if zero); without replayed rows the latter is 1e-9 too.
    """
    gap = (F.col("chosen") - F.col("ref_chosen")) ** 2 + (F.col("rejected") - F.col("ref_rejected")) ** 2
    fit = F.avg(F.when(F.col(is_new), gap))
    reg = F.avg(F.when(~F.col(is_new), gap))
    one = df.agg(F.avg(pair_loss(F.col("chosen"), F.col("rejected"))).alias("dpo_loss"), fit.alias("rdpo_loss"), reg.alias("reg_loss"))
    one = one.withColumn("reg_loss", F.when(F.coalesce("reg_loss", F.lit(0.0)) == 0.0, F.lit(1e-9)).otherwise(F.col("reg_loss")))
    total = 1 + lam
    loss = (F.lit(coef) * F.col("rdpo_loss") + F.lit(lam / total) * F.col("reg_loss") + F.col("dpo_loss")) / F.lit(total)
    return one.withColumn("loss", loss).withColumn("log_lambda_step", F.lit(rate * lam) * (F.col("reg_loss") - F.lit(threshold)))
