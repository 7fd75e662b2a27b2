"""The tables the queries run on, as Spark plans and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.session import table

SAMPLES_SQL = (
    "s AS (SELECT sample_id, dataset_idx, sample_idx, split, source, coalesce(prompt,'') AS prompt, coalesce(chosen,'') AS chosen, coalesce(rejected,'') AS rejected"
    " FROM samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at)=1)"
)


def samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each sample once, nulls as empty texts.  Deliveries of a sample have the same content, so any one will do."""
    wanted = columns or ("sample_id", "dataset_idx", "sample_idx", "split", "source", "prompt", "chosen", "rejected")
    keep = dict.fromkeys(("sample_id", *wanted))
    one = table(spark, sf_dir, "samples").select(*keep).dropDuplicates(["sample_id"])
    return one.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("prompt", "chosen", "rejected") else F.col(c) for c in wanted))


SCORES_SQL = (
    "j AS (SELECT sample_id, metric, greatest(0, least(10, score)) AS score FROM judge_scores WHERE score IS NOT NULL AND sample_id IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY sample_id, metric ORDER BY judged_at DESC, score_id DESC)=1)"
)

#: One rollout for each user: rewards are values / 100, value estimates the reward before.
ROLLOUT_SQL = (
    "e AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i, value/100 AS r, coalesce(lag(value) OVER w, 0)/100 AS v FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, r, v, n): arrays by time.  A rollout is an array by definition, one for each user."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("user_id", "ts", "event_id", (F.col("value") / 100).alias("r"), (F.coalesce(F.lag("value").over(w), F.lit(0.0)) / 100).alias("v"))
    grouped = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "r", "v"))).alias("a"))
    return grouped.select("user_id", F.transform("a", lambda x: x["r"]).alias("r"), F.transform("a", lambda x: x["v"]).alias("v"), F.size("a").alias("n"))
