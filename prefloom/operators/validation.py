"""Quality reports, one row for each dataset."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import digest, kept_tokens, render_sample, tokens, without_stop_words, word_count
from prefloom.operators.ordered import exact_median
from prefloom.schema import TEXT_FIELDS
from prefloom.session import arrow_map, cut


def _for_all(report: DataFrame, tasks: DataFrame | None) -> DataFrame:
    """Keep a row for datasets without samples."""
    return report if tasks is None else tasks.select("dataset_idx").join(report, "dataset_idx", "left")


def count_validation(samples: DataFrame, tasks: DataFrame | None = None, remove_stop_words: bool = False, key: str | None = None) -> DataFrame:
    """Samples, distinct samples, prompts, chosen and rejected texts, and mean words of each dataset.

    Distinct samples are distinct renderings; stop words are removed from a rendering as a whole, so the last word of a prompt, with
    the comma that follows it there, is none.  Removing them changes the distinct counts only.  Null texts count as
    empty.  With ``tasks`` datasets without samples have zeros.  ``key`` names a column by which repeated deliveries count once.

    Texts become digests and word counts where they are read, so no text is shuffled; distinct digests are found by one
    aggregation over (dataset, kind, digest), in which copies collapse before the shuffle.
    """
    clean = without_stop_words if remove_stop_words else (lambda c: F.coalesce(F.col(c), F.lit("")))
    facts = samples.select(
        "dataset_idx",
        *([key] if key else []),
        *(digest(clean(c)).alias(f"d_{c}") for c in TEXT_FIELDS),
        digest(without_stop_words(render_sample()) if remove_stop_words else render_sample()).alias("d_sample"),
        *(word_count(c).alias(f"w_{c}") for c in TEXT_FIELDS),
    )
    if key:
        facts = facts.dropDuplicates([key])
    kinds = ("sample", *TEXT_FIELDS)
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"d_{k}").alias("d"), (F.col(f"w_{k}") if k != "sample" else F.lit(0)).alias("words")) for i, k in enumerate(kinds))))
    each = facts.select("dataset_idx", parts.alias("p")).select("dataset_idx", "p.*").groupBy("dataset_idx", "kind", "d").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    of = lambda i, c: F.sum(F.when(F.col("kind") == i, c).otherwise(0))
    report = each.groupBy("dataset_idx").agg(
        of(0, F.col("n")).alias("sample"),
        of(0, F.lit(1)).alias("unique_samples"),
        *(of(i, F.lit(1)).alias(f"unique_{name}") for i, name in ((1, "prompts"), (2, "chosen"), (3, "rejected"))),
        *((of(i, F.col("words")) / of(i, F.col("n"))).alias(f"avg_{k}_length") for i, k in enumerate(TEXT_FIELDS, 1)),
    )
    names = [c for c in report.columns if c != "dataset_idx"]
    return _for_all(report, tasks).select("dataset_idx", *(F.coalesce(c, F.lit(0).cast(report.schema[c].dataType)).alias(c) for c in names))


def word_frequencies(samples: DataFrame, remove_stop_words: bool = False) -> DataFrame:
    """(dataset_idx, field, word, n): how often each word stands in each column of a dataset."""
    words = kept_tokens if remove_stop_words else tokens
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), words(c).alias("words")) for c in TEXT_FIELDS)))
    return samples.select("dataset_idx", fields.alias("f")).select("dataset_idx", "f.field", F.explode("f.words").alias("word")).groupBy("dataset_idx", "field", "word").agg(F.count("*").alias("n"))


def entropy_validation(samples: DataFrame, tasks: DataFrame | None = None, remove_stop_words: bool = False) -> DataFrame:
    """Shannon entropy (nats) of the words of each column, pooled over a dataset; 0 without words."""
    by = word_frequencies(samples, remove_stop_words).groupBy("dataset_idx", "field").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s"))
    value = F.log("total") - F.col("s") / F.col("total")
    wide = by.groupBy("dataset_idx").agg(*(F.max(F.when(F.col("field") == c, value)).alias(f"{c}_entropy") for c in TEXT_FIELDS))
    base = samples.select("dataset_idx").distinct() if tasks is None else tasks.select("dataset_idx")
    return base.join(wide, "dataset_idx", "left").select("dataset_idx", *(F.coalesce(f"{c}_entropy", F.lit(0.0)).alias(f"{c}_entropy") for c in TEXT_FIELDS))


def totals(samples: DataFrame, by_dataset: bool = True) -> DataFrame:
    """Samples, train and test samples, and their shares, of each dataset or of the series (with its number of datasets)."""
    train = F.sum((F.col("split") == "train").cast("int"))
    aggs = [F.count("*").alias("num_samples"), F.coalesce(train, F.lit(0)).alias("num_train_samples")]
    out = samples.groupBy("dataset_idx").agg(*aggs) if by_dataset else samples.agg(F.countDistinct("dataset_idx").alias("num_datasets"), *aggs)
    n = F.greatest(F.col("num_samples"), F.lit(1))
    return out.withColumns({"num_test_samples": F.col("num_samples") - F.col("num_train_samples"), "train_frac": F.col("num_train_samples") / n}).withColumn(
        "test_frac", F.col("num_test_samples") / n
    )


def shortfall(requested: DataFrame, samples: DataFrame) -> DataFrame:
    """(dataset_idx, requested, produced, missing) for ``requested`` (dataset_idx, num_samples)."""
    made = samples.groupBy("dataset_idx").agg(F.count("*").alias("produced"))
    out = requested.select("dataset_idx", F.col("num_samples").cast("long").alias("requested")).join(made, "dataset_idx", "left")
    out = out.withColumn("produced", F.coalesce("produced", F.lit(0)))
    return out.withColumn("missing", F.col("requested") - F.col("produced"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors as unit rows; a shorter vector counts as filled with zeros, a null entry as zero."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    width = int(size.max()) if len(size) else 0
    if len(flat) == len(size) * width:
        m = flat.reshape(len(size), width)
    else:
        m = np.zeros((len(size), width))
        m[np.arange(width) < size[:, None]] = flat
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(groups..., vector) to one (groups..., [rows, sum of unit vectors...]) row for each group of a batch."""
    for batch in batches:
        keys = pa.Table.from_batches([batch]).drop_columns(["_pf_v"]).append_column("_pf_i", pa.array(np.arange(batch.num_rows)))
        names = [c for c in keys.column_names if c != "_pf_i"]
        groups = keys.group_by(names).aggregate([("_pf_i", "list")])
        m = _matrix(batch.column(batch.num_columns - 1))
        out = [np.append(len(i), m[i].sum(axis=0)) for i in groups["_pf_i_list"].to_pylist()]
        yield pa.record_batch([*(groups[n].combine_chunks() for n in names), pa.array(out, pa.list_(pa.float64()))], [*names, "_pf_sum"])


def _dissimilar(batches: Iterator[pa.RecordBatch], at: int, total: int, name: str) -> Iterator[pa.RecordBatch]:
    """Add 1 less the mean similarity of the vector in column ``at`` to its group, whose sums in column ``total`` are dropped."""
    for batch in batches:
        a, b = _matrix(batch.column(at)), batch.column(total)
        size = b.value_lengths().to_numpy(zero_copy_only=False)
        flat = b.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(size) - size
        places = np.arange(1, a.shape[1] + 1)
        # a group's sum is as long as its longest vector
        grid = np.minimum(first[:, None] + places, max(0, len(flat) - 1))
        dot = (a * np.where(places < size[:, None], flat[grid] if len(flat) else 0.0, 0.0)).sum(axis=1)
        keep = [i for i in range(batch.num_columns) if i != total]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(1.0 - dot / flat[first])], [*(batch.schema.names[i] for i in keep), name])


def diversity(rows: DataFrame, vector: str, groups: list[str], value: str = "diversity") -> DataFrame:
    """Add to each row 1 less its mean cosine similarity to all rows of its group, itself included.

    The unit vectors are summed by group, batch by batch, so the cost is rows times dimensions and no pair is formed.  A zero
    vector has similarity 0 to all.  Null vectors are left out; rows with null groups are groups like others.
    """
    rows = rows.where(F.col(vector).isNotNull())
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    part = arrow_map(rows.select(*groups, F.col(vector).alias("_pf_v")), _sums, f"{kinds}, _pf_sum array<double>")
    each = part.select(*groups, F.posexplode("_pf_sum").alias("_pf_d", "_pf_x")).groupBy(*groups, "_pf_d").agg(F.sum("_pf_x").alias("_pf_s"))
    # one short array a group
    keys = [f"_pf_g{i}" for i in range(len(groups))]
    total = each.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pf_d", "_pf_s"))), lambda e: e["_pf_s"]).alias("_pf_sum"))
    joined = rows.join(total, reduce(and_, (rows[g].eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)))).drop(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_pf_sum", value)) + f", `{value}` double"
    joined = joined.drop(value)
    at, where = joined.columns.index(vector), joined.columns.index("_pf_sum")
    return arrow_map(joined, lambda it: _dissimilar(it, at, where, value), schema)


def diversity_report(rows: DataFrame, vector: str, groups: list[str]) -> DataFrame:
    """Mean, exact median, least and greatest diversity of each group."""
    each = cut(diversity(rows, vector, groups).select(*groups, "diversity"), "diversity")  # a number a row, read several times
    plain = each.groupBy(*groups).agg(F.avg("diversity").alias("mean"), F.min("diversity").alias("min"), F.max("diversity").alias("max"))
    median = exact_median(each, groups, "diversity").select(*(F.col(g).alias(f"_pf_g{i}") for i, g in enumerate(groups)), "median")
    match = reduce(and_, (plain[g].eqNullSafe(F.col(f"_pf_g{i}")) for i, g in enumerate(groups)))
    return plain.join(median, match).select(*groups, "mean", "median", "min", "max")


def clamped(score: Column | str) -> Column:
    """A judge's score within 0 and 10; null stays null."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), s)))


def latest_scores(scores: DataFrame) -> DataFrame:
    """One score for each sample and metric: the last one given that isn't null, clamped (sample_id, metric, score)."""
    last = F.max_by(F.struct("score"), F.struct("judged_at", "score_id"))["score"]
    return scores.where("score is not null and sample_id is not null").groupBy("sample_id", "metric").agg(clamped(last).alias("score"))


METRICS = ("alignment", "coherence_chosen", "coherence_rejected")


def judge_report(samples: DataFrame, scores: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Score statistics of each dataset and metric side by side; metrics without a score are null.

    ``scores`` is one row for each sample_id and metric, as from ``latest_scores``; samples have distinct sample_ids.  The medians are
    exact; clamped scores have eleven values, so counting them takes little memory whatever the dataset's size.
    """
    joined = samples.select("sample_id", "dataset_idx").join(scores, "sample_id")
    wide = joined.groupBy("dataset_idx").agg(
        *(F.avg(F.when(F.col("metric") == m, F.col("score"))).alias(f"{m}_mean") for m in METRICS),
        *(F.percentile(F.when(F.col("metric") == m, F.col("score")), F.lit(0.5)).alias(f"{m}_median") for m in METRICS),
        *(F.min(F.when(F.col("metric") == m, F.col("score"))).alias(f"{m}_min") for m in METRICS),
        *(F.max(F.when(F.col("metric") == m, F.col("score"))).alias(f"{m}_max") for m in METRICS),
    )
    base = samples.select("dataset_idx").distinct() if tasks is None else tasks.select("dataset_idx")
    return base.join(wide, "dataset_idx", "left")


def judge_coverage(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """(dataset_idx, metric, samples, scored, coverage) for each dataset and metric."""
    size = samples.groupBy("dataset_idx").agg(F.count("*").alias("samples"))
    size = size.withColumn("metric", F.explode(F.array(*(F.lit(m) for m in METRICS))))
    hit = samples.select("sample_id", "dataset_idx").join(scores, "sample_id").groupBy("dataset_idx", "metric").agg(F.count("score").alias("scored"))
    out = size.join(hit, ["dataset_idx", "metric"], "left").withColumn("scored", F.coalesce("scored", F.lit(0)))
    return out.withColumn("coverage", F.col("scored") / F.col("samples"))


def unpivot_texts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text_type, text): the three texts of each sample in rows."""
    return samples.select(*keys, *TEXT_FIELDS).unpivot(keys, list(TEXT_FIELDS), "text_type", "text")
