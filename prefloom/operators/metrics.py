"""Roll-ups of training metrics and of per-parameter tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import metric_key
from prefloom.session import arrow_map


def metric_rollup(metrics: DataFrame) -> DataFrame:
    """Means of logged values by key.

    ``metrics`` has split, task (may be null), is_final, key, value.  A value counts under its own key; under task/<task>/<key> if
    it has a task; and under eval.last/<key> if it is a final evaluation.  Null values are left out of means.
    """
    k = F.col("key")
    keys = F.array_compact(
        F.array(
            F.struct(F.col("split").alias("split"), k.alias("key")),
            F.when(F.col("task").isNotNull(), F.struct(F.lit("task").alias("split"), F.concat(F.lit("task/"), "task", F.lit("/"), k).alias("key"))),
            F.when((F.col("split") == "eval") & F.col("is_final"), F.struct(F.lit("eval.last").alias("split"), F.concat(F.lit("eval.last/"), k).alias("key"))),
        )
    )
    return metrics.select(F.explode(keys).alias("k"), "value").groupBy("k.split", "k.key").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def append_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Append a run's metrics (key, value and any others) to a Parquet table partitioned by run; nothing is read or rewritten."""
    metrics.withColumns({"run": F.lit(run), "logged": F.current_timestamp()}).write.partitionBy("run").mode("append").parquet(path)


def prefixed(metrics: DataFrame) -> DataFrame:
    """Keys with their dataset before them: dataset-<i>/<key>."""
    return metrics.withColumn("key", metric_key("dataset_idx", "key"))


def mean_eval_reward(scores: DataFrame, batch: int) -> DataFrame:
    """Mean score of each dataset over full batches only (row_idx counts from 0); null if there is none."""
    full = scores.groupBy("dataset_idx").agg((F.floor(F.count("*") / batch) * batch).alias("_pf_use"))
    joined = scores.join(full, "dataset_idx").withColumn("_pf_s", F.when(F.col("row_idx") < F.col("_pf_use"), F.col("score")))
    return joined.groupBy("dataset_idx").agg(F.avg("_pf_s").alias("mean_reward"), F.count("_pf_s").alias("used"))


def top_importance(fisher: DataFrame, n: int = 20) -> DataFrame:
    """The n parameters (name, value) with the greatest sums; ties by name.  A top-k, not a full sort."""
    return fisher.groupBy("name").agg(F.sum("value").alias("importance")).orderBy(F.desc("importance"), "name").limit(n)


def importance_from_gradients(gradients: DataFrame, kind: str = "fisher") -> DataFrame:
    """Per (name, idx): the mean squared gradient (fisher) or mean absolute gradient (mas)."""
    g = {"fisher": F.col("grad") * F.col("grad"), "mas": F.abs("grad")}[kind]
    return gradients.groupBy("name", "idx").agg(F.avg(g).alias("value"))


def drift_penalty(importance: DataFrame, before: DataFrame, now: DataFrame, weight: float, kind: str = "ewc") -> DataFrame:
    """One row: weight (halved for ewc) times the importance-weighted squared change of all parameters (name, idx, theta)."""
    factor = {"ewc": weight / 2, "mas": weight}[kind]
    keys = ["name", "idx"]
    joined = importance.join(before.withColumnRenamed("theta", "_pf_old"), keys).join(now.withColumnRenamed("theta", "_pf_new"), keys)
    gap = (F.col("_pf_new") - F.col("_pf_old")) * (F.col("_pf_new") - F.col("_pf_old"))
    return joined.agg((F.coalesce(F.sum(F.col("value") * gap), F.lit(0.0)) * F.lit(factor)).alias("penalty"))


def completions(evaluated: DataFrame, batch: int) -> DataFrame:
    """query, response and score of the first batch of evaluation rows (row_idx from 0)."""
    return evaluated.where(F.col("row_idx") < batch).select("row_idx", "query", "response", "score")


def checkpoint_order(paths: DataFrame) -> DataFrame:
    """Checkpoint paths in their textual order, with dataset and checkpoint names; other paths are left out."""
    p = F.col("path")
    return paths.where(p.contains("checkpoint")).select("path", F.element_at(F.split(p, "/"), -2).alias("run"), F.element_at(F.split(p, "/"), -1).alias("checkpoint")).orderBy("path")


_tokenizers: dict = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str, content: str, fields: int) -> Iterator[pa.RecordBatch]:
    if path not in _tokenizers:  # once for each worker process
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_str(content)
        _tokenizers[path].encode_special_tokens = True
    t = _tokenizers[path]
    for batch in batches:
        keys = batch.num_columns - fields
        out = [pa.array([e.ids for e in t.encode_batch([x or "" for x in batch.column(keys + f).to_pylist()], add_special_tokens=False)], pa.list_(pa.int32())) for f in range(fields)]
        names = batch.schema.names
        yield pa.record_batch([*batch.columns[:keys], *out], [*names[:keys], *(f"{n}_ids" for n in names[keys:])])


def tokenize(df: DataFrame, keys: list[str], fields: list[str], path: str) -> DataFrame:
    """Token ids of text columns by a tokenizer file; other columns are dropped.  Null texts give no ids.

    The file (of fixed size) travels with the job, so workers need no copy.
    """
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    picked = df.select(*keys, *fields)
    kinds = ", ".join([*(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys), *(f"`{f}_ids` array<int>" for f in fields)])
    return arrow_map(picked, lambda it: _encode(it, path, content.value, len(fields)), kinds)
