"""Row-wise and positional transforms of a samples table.

A samples table has dataset_idx INT, sample_idx BIGINT, prompt, chosen, rejected STRING and, where a function
says so, split STRING.  Extra columns are kept.  All functions return new tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.rng import hash_uniform
from prefloom.functions.text import category, word_count
from prefloom.operators.ordered import rank_within
from prefloom.session import cut


class DatasetTransform:
    """A named transform; call it or use ``df.transform(t)``."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no apply")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def __str__(self) -> str:
        return type(self).__name__


def _share(name: str, value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1, not {value}")
    return float(value)


def preference_swap(df: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """Swap chosen and rejected of each row with the given probability.

    The draw depends on seed, dataset_idx and sample_idx only; 0 leaves the table as it is and 1 swaps every row.
    """
    p = _share("the swap probability", probability)
    if p == 0:
        return df
    return swap_where(df, F.lit(True) if p == 1 else hash_uniform(seed, "dataset_idx", "sample_idx") < F.lit(p))


def swap_where(df: DataFrame, condition: Column) -> DataFrame:
    """Swap chosen and rejected where the condition is true (null counts as false)."""
    swap = F.coalesce(condition, F.lit(False))
    return df.withColumns(
        {"chosen": F.when(swap, F.col("rejected")).otherwise(F.col("chosen")), "rejected": F.when(swap, F.col("chosen")).otherwise(F.col("rejected"))}
    )


def swap_by_verdict(df: DataFrame, scores: DataFrame, keys: Sequence[str] = ("dataset_idx", "sample_idx")) -> DataFrame:
    """Swap rows whose judge score is 0, keep those with 1; other scores and rows without one stay as they are.

    ``scores`` has the keys and ``score``, one row a key; it is joined by key, never by position.
    """
    verdict = scores.where(F.col("score").isin(0.0, 1.0)).select(*keys, F.col("score").alias("_pf_score"))
    return swap_where(df.join(verdict, list(keys), "left"), F.col("_pf_score") == 0.0).drop("_pf_score")


class PreferenceSwap(DatasetTransform):
    def __init__(self, probability: float, seed: int = 0) -> None:
        self.probability, self.seed = _share("the swap probability", probability), seed

    def apply(self, df: DataFrame) -> DataFrame:
        return preference_swap(df, self.probability, self.seed)


def split(df: DataFrame, test_ratio: float) -> DataFrame:
    """Positional split of each dataset: the first int((1 - test_ratio) * n) rows are train, the rest test.

    Raises ValueError if a row is in the test split already; without a split column all rows count as train.
    """
    ratio = _share("the test ratio", test_ratio)
    if "split" in df.columns and not df.where(F.col("split") == "test").isEmpty():
        raise ValueError("there is a test split already")
    return split_at(df.drop("split"), 1 - ratio)


def split_at(df: DataFrame, train_frac: float | Column) -> DataFrame:
    """Add ``split`` by position: rank by sample_idx within dataset_idx, train up to int(train_frac * n)."""
    frac = F.lit(_share("the train fraction", train_frac)) if isinstance(train_frac, int | float) else train_frac
    sizes = df.groupBy("dataset_idx").agg(F.count("*").alias("_pf_size"))
    ranked = rank_within(df, ["dataset_idx"], "sample_idx", ["sample_idx"], "_pf_rank").join(sizes, "dataset_idx")
    return ranked.withColumn("split", F.when(F.col("_pf_rank") <= (frac * F.col("_pf_size")).cast("long"), "train").otherwise("test")).drop("_pf_rank", "_pf_size")


class Split(DatasetTransform):
    def __init__(self, test_ratio: float) -> None:
        self.test_ratio = _share("the test ratio", test_ratio)

    def apply(self, df: DataFrame) -> DataFrame:
        return split(df, self.test_ratio)


def stored_fractions(df: DataFrame) -> DataFrame:
    """(dataset_idx, train_frac): what a file that stores only both lists implies; null for an empty dataset."""
    train = F.sum(F.when(F.col("split") == "train", 1).otherwise(0))
    return df.groupBy("dataset_idx").agg((train / F.count("*")).alias("train_frac"))


def resplit_compatible(df: DataFrame) -> DataFrame:
    """Cut again at int(train_frac * n) as a reader of such a file does; the boundary may move by one row.

    Rows are ordered train first, then by sample_idx, and numbered anew.
    """
    order = F.when(F.col("split") == "train", 0).otherwise(1)
    ranked = rank_within(df, ["dataset_idx", "split"], "sample_idx", ["sample_idx"], "_pf_place")
    train = df.groupBy("dataset_idx").agg(F.sum(1 - order).alias("_pf_t"))
    numbered = ranked.join(train, "dataset_idx").withColumn("sample_idx", F.col("_pf_place") - 1 + order * F.col("_pf_t")).drop("_pf_place", "_pf_t")
    return split_at(numbered.join(stored_fractions(df), "dataset_idx").drop("split"), F.col("train_frac")).drop("train_frac")


def merge(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All datasets of several series one after another; each series' indexes are shifted by those before it.

    The next index is the greatest index so far plus one; nothing is deduplicated.
    """
    out = first
    for df in more:
        last = out.agg(F.max("dataset_idx")).first()[0]  # one number
        shift = 0 if last is None else last + 1
        out = out.unionByName(df.withColumn("dataset_idx", (F.col("dataset_idx") + F.lit(shift)).cast("int")))
    return out


def append(series: DataFrame, dataset: DataFrame) -> DataFrame:
    """Add one dataset at the end; TypeError if it isn't a samples table."""
    missing = {"dataset_idx", "sample_idx", "prompt", "chosen", "rejected"} - set(dataset.columns)
    if missing:
        raise TypeError(f"not a samples table: {sorted(missing)} missing")
    return merge(series, dataset)


def with_global_index(df: DataFrame) -> DataFrame:
    """Add ``global_idx``, counted from 0 over all datasets in order of (dataset_idx, sample_idx)."""
    ranked = rank_within(df, ["dataset_idx"], "sample_idx", ["sample_idx"], "_pf_rank")
    sizes = df.groupBy("dataset_idx").agg(F.count("*").alias("_pf_size"))  # one row a dataset
    from pyspark.sql import Window

    before = sizes.select("dataset_idx", F.coalesce(F.sum("_pf_size").over(Window.orderBy("dataset_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_pf_before"))
    return ranked.join(before, "dataset_idx").withColumn("global_idx", F.col("_pf_before") + F.col("_pf_rank") - 1).drop("_pf_before", "_pf_rank")


def take_slice(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows [start, stop) of the whole series; negative bounds count from the end, as in a Python slice.

    The datasets' sizes (one number each) tell which of them the slice touches; only those are ranked.
    """
    sizes = df.where("dataset_idx is not null").groupBy("dataset_idx").count().orderBy("dataset_idx").collect()
    low, high, _ = slice(start, stop).indices(sum(r[1] for r in sizes))
    before, offsets = 0, {}
    for index, n in sizes:
        if before < high and before + n > low:
            offsets[index] = before
        before += n
    # one row for each dataset touched
    table = df.sparkSession.createDataFrame(list(offsets.items()), "_pf_d int, _pf_start long")
    touched = df.join(F.broadcast(table), F.col("dataset_idx") == F.col("_pf_d")).drop("_pf_d")
    ranked = rank_within(touched, ["dataset_idx"], "sample_idx", ["sample_idx"], "_pf_rank")
    ranked = ranked.withColumn("global_idx", F.col("_pf_start") + F.col("_pf_rank") - 1).drop("_pf_start", "_pf_rank")
    return ranked.where((F.col("global_idx") >= low) & (F.col("global_idx") < high))


def take_at(df: DataFrame, index: int) -> DataFrame:
    """The one row at an index, negative from the end; IndexError outside."""
    n = df.where("dataset_idx is not null").count()
    if not -n <= index < n:
        raise IndexError(index)
    return take_slice(df, index % n, index % n + 1)


def take_first(df: DataFrame, amount: int, groups: Sequence[str] = ("dataset_idx",)) -> DataFrame:
    """At most ``amount`` rows of each group, by sample_idx."""
    return rank_within(df, list(groups), "sample_idx", ["sample_idx"], "_pf_rank").where(F.col("_pf_rank") <= amount).drop("_pf_rank")


def stratified_sample(
    df: DataFrame,
    ratio_train: float = 1.0,
    ratio_test: float = 1.0,
    amount_train: int | None = None,
    amount_test: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Sample without replacement from each dataset and split: int(ratio * n) rows, or an amount instead, at most n.

    Rows keep their split; ``sample_order`` counts the sampled rows of each stratum from 1 in their drawn order.
    """
    _share("a ratio", ratio_train), _share("a ratio", ratio_test)
    sizes = df.groupBy("dataset_idx", "split").agg(F.count("*").alias("_pf_n"))

    def wanted(ratio: float, amount: int | None) -> Column:
        return (F.lit(float(ratio)) * F.col("_pf_n")).cast("long") if amount is None else F.lit(amount).cast("long")

    k = F.least(F.col("_pf_n"), F.when(F.col("split") == "train", wanted(ratio_train, amount_train)).otherwise(wanted(ratio_test, amount_test)))
    sizes = sizes.withColumn("_pf_k", k).drop("_pf_n")
    drawn = rank_within(df, ["dataset_idx", "split"], hash_uniform(seed, "dataset_idx", "sample_idx"), ["sample_idx"], "sample_order")
    return drawn.join(sizes, ["dataset_idx", "split"]).where(F.col("sample_order") <= F.col("_pf_k")).drop("_pf_k")


def quality_filter(df: DataFrame, least_words: int = 5) -> DataFrame:
    """Drop rows whose answers are equal, or of which one has fewer than five words.  Null answers have no words."""
    return df.where((F.col("chosen") != F.col("rejected")) & (word_count("chosen") >= least_words) & (word_count("rejected") >= least_words))


def category_filter(df: DataFrame, wanted: str) -> DataFrame:
    """Rows of one prompt category."""
    if wanted not in ("relationships", "others"):
        raise ValueError(wanted)
    return df.where(category("prompt") == wanted)


def in_batches(df: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Add ``batch``, counted from 0, of ``size`` rows in sample order within each dataset; the last may be short or left out."""
    if size <= 0:
        raise ValueError("a batch has at least one row")
    ranked = rank_within(df, ["dataset_idx"], "sample_idx", ["sample_idx"], "_pf_rank").withColumn("batch", F.floor((F.col("_pf_rank") - 1) / size))
    if drop_last:
        full = df.groupBy("dataset_idx").agg(F.floor(F.count("*") / size).alias("_pf_full"))
        ranked = ranked.join(full, "dataset_idx").where(F.col("batch") < F.col("_pf_full")).drop("_pf_full")
    return ranked.drop("_pf_rank")


def minibatches(df: DataFrame, size: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """A random permutation of each dataset cut into minibatches; ``place`` is the row's place in its permutation, from 0."""
    ranked = rank_within(df, ["dataset_idx"], hash_uniform(seed, "dataset_idx", "sample_idx"), ["sample_idx"], "_pf_rank").withColumn("place", F.col("_pf_rank") - 1)
    ranked = ranked.withColumn("batch", F.floor(F.col("place") / size)).drop("_pf_rank")
    if drop_last:
        full = df.groupBy("dataset_idx").agg(F.floor(F.count("*") / size).alias("_pf_full"))
        ranked = ranked.join(full, "dataset_idx").where(F.col("batch") < F.col("_pf_full")).drop("_pf_full")
    return ranked


def preview(df: DataFrame, dataset_idx: int, split_name: str, at: int, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """The row shown at place ``at`` (from 0) of one dataset's split, in shuffled or sample order."""
    part = df.where((F.col("dataset_idx") == dataset_idx) & (F.col("split") == split_name))
    order = [hash_uniform(seed, "dataset_idx", "sample_idx"), F.col("sample_idx")] if shuffle else [F.col("sample_idx")]
    return part.orderBy(*order).offset(at).limit(1)


def replay_buffer(df: DataFrame, ratio: float | None = None, per_task: int | None = None, capacity: int = 1000, seed: int = 0) -> DataFrame:
    """The memory kept after each dataset of the series.

    After dataset t, a uniform sample of its rows (max(1, int(ratio * n)), else ``per_task``, else the capacity; at most all
    of them) joins the buffer, which is then re-sampled if it exceeds ``capacity``.  Returns the rows with ``after`` (the
    dataset index).  The buffer has at most ``capacity`` rows, so each step is a short top-k over bounded data; datasets are visited in
    order by the driver.
    """
    steps = [r[0] for r in df.select("dataset_idx").distinct().orderBy("dataset_idx").collect()]
    sizes = {r[0]: r[1] for r in df.groupBy("dataset_idx").count().collect()}
    keep = {t: min(sizes[t], max(1, int(sizes[t] * ratio)) if ratio is not None else (per_task or capacity)) for t in steps}
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(keep.items()), "dataset_idx int, _pf_k long")) if steps else None
    if wanted is None:
        return df.withColumn("after", F.col("dataset_idx")).limit(0)
    first = rank_within(df, ["dataset_idx"], hash_uniform(f"{seed}-add", "dataset_idx", "sample_idx"), ["sample_idx"], "_pf_rank")
    added = cut(first.join(wanted, "dataset_idx").where(F.col("_pf_rank") <= F.col("_pf_k")).drop("_pf_rank", "_pf_k"), "additions")
    out = None
    buffer = None
    for t in steps:
        new = added.where(F.col("dataset_idx") == t)
        buffer = new if buffer is None else buffer.unionByName(new)
        # orderBy + limit is a top-k per partition followed by a merge, never a full sort; each step's lineage is cut
        buffer = cut(buffer.orderBy(hash_uniform(f"{seed}-keep-{t}", "dataset_idx", "sample_idx"), "dataset_idx", "sample_idx").limit(capacity), "buffer")
        held = buffer.withColumn("after", F.lit(t))
        out = held if out is None else out.unionByName(held)
    return out
