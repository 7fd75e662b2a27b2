"""Series built from public corpora: named recipes of row ranges, and the two-task summarisation corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions.text import category, word_count
from prefloom.operators.ordered import rank_within
from prefloom.schema import TEXT_FIELDS

#: The datasets of each series as (corpus, rows of train, rows of test); a range of None is the whole split.
RECIPES: dict[str, list[tuple[str, tuple[int, int] | None, tuple[int, int] | None]]] = {
    "debug": [("ultrafeedback_binarized", (0, 100), (0, 100)), ("ultrafeedback_binarized", (100, 200), (100, 200)), ("hh_rlhf", (0, 100), (0, 100))],
    "ultrafeedback_to_hh_reduced": [("ultrafeedback_binarized", (0, 35200), (0, 1000)), ("hh_rlhf", (0, 35200), (0, 1000))],
    "ultrafeedback_to_hh": [("ultrafeedback_binarized", None, None), ("hh_rlhf", None, None)],
}
#: Most train rows, most test rows, and train rows kept back from reinforcement learning, for each category in task order.
TASK_LIMITS = {"relationships": (52_243, 45_148, 3_462), "others": (40_291, 38_481, 2_985)}


def load_series(spark: SparkSession, name: str, paths: dict[str, str]) -> DataFrame:
    """The samples (dataset_idx, split, row_idx, texts) of a recipe; ``paths`` names the Parquet folder of each corpus.

    A corpus has split, row_idx (its order) and the text columns.  A range takes the rows whose row_idx lies in it; each range is a
    filter on the scan.  Raises ValueError for an unknown recipe or a corpus without a path.
    """
    if name not in RECIPES:
        raise ValueError(f"unknown series: {name}")
    out = None
    for index, (corpus, *ranges) in enumerate(RECIPES[name]):
        if corpus not in paths:
            raise ValueError(f"no path for {corpus}")
        rows = spark.read.parquet(paths[corpus])
        keep = F.lit(False)
        for split, limits in zip(("train", "test"), ranges, strict=True):
            inside = F.lit(True) if limits is None else F.col("row_idx").between(limits[0], limits[1] - 1)
            keep = keep | ((F.col("split") == split) & inside)
        part = rows.where(keep).select(F.lit(index).alias("dataset_idx"), "split", F.col("row_idx").cast("long"), *TEXT_FIELDS)
        out = part if out is None else out.unionByName(part)
    return out


def task_corpora(comparisons: DataFrame, order: str = "row_idx", limits: dict[str, tuple[int, int, int]] = TASK_LIMITS) -> DataFrame:
    """The corpora of a series of one task for each category: (purpose, dataset_idx, split, ``order``, texts).

    ``comparisons`` has split, ``order`` and the texts.  Of each category and split the first rows are taken, up to its limit.
    Purpose ``reward`` leaves out rows whose answers are equal or of which one has under five words (a null answer has none);
    purpose ``rl`` keeps them all, and of train only the limit less the rows kept back.
    """
    task = {name: i for i, name in enumerate(limits)}
    pick = lambda at: F.element_at(F.create_map(*(x for name, v in limits.items() for x in (F.lit(name), F.lit(at(v))))), F.col("_pf_c"))
    rows = comparisons.where(F.col("split").isin("train", "test")).select("split", order, *TEXT_FIELDS).withColumn("_pf_c", category("prompt"))
    rows = rows.where(F.col("_pf_c").isin(list(task)))
    ranked = rank_within(rows, ["_pf_c", "split"], order, [order], "_pf_k")
    most = F.when(F.col("split") == "train", pick(lambda v: v[0])).otherwise(pick(lambda v: v[1]))
    for_rl = F.col("_pf_k") <= F.when(F.col("split") == "train", pick(lambda v: v[0] - v[2])).otherwise(pick(lambda v: v[1]))
    good = (F.col("chosen") != F.col("rejected")) & (word_count("chosen") >= 5) & (word_count("rejected") >= 5)
    purposes = F.array_compact(F.array(F.when(F.coalesce(good, F.lit(False)), F.lit("reward")), F.when(for_rl, F.lit("rl"))))
    index = F.element_at(F.create_map(*(x for name, i in task.items() for x in (F.lit(name), F.lit(i)))), F.col("_pf_c"))
    return ranked.where(F.col("_pf_k") <= most).select(F.explode(purposes).alias("purpose"), index.alias("dataset_idx"), "split", order, *TEXT_FIELDS)


def save_task_corpora(comparisons: DataFrame, path: str, order: str = "row_idx", limits: dict[str, tuple[int, int, int]] = TASK_LIMITS) -> None:
    """Write ``task_corpora`` as Parquet folders for each purpose, dataset and split."""
    task_corpora(comparisons, order, limits).write.partitionBy("purpose", "dataset_idx", "split").mode("overwrite").parquet(path)


def load_task_corpora(spark: SparkSession, path: str, purpose: str) -> DataFrame:
    """One purpose's samples of such a folder; only its files are read."""
    if purpose not in ("reward", "rl"):
        raise ValueError(purpose)
    return spark.read.parquet(path).where(F.col("purpose") == purpose).drop("purpose")
