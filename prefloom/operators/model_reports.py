"""Reports that ask a model: judged quality and the diversity of embedded texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators import generation, validation
from prefloom.schema import TEXT_FIELDS
from prefloom.session import arrow_map, cut

STATS = ("mean", "median", "min", "max")


def judge_scores(samples: DataFrame, tasks: DataFrame, client: generation.ModelClient, cache: DataFrame | None = None, max_tokens: int = 128, max_concurrency: int = 128) -> tuple[DataFrame, DataFrame]:
    """((sample_id, metric, score), new cache rows): the judge's scores of every sample at temperature 0.

    ``samples`` has sample_id, dataset_idx and the texts.  A score is clamped to 0..10; an invalid reply gives none.
    """
    requests = generation.judge_requests(samples, tasks, ["sample_id"]).withColumn("nonce", F.lit(None).cast("string"))
    replies, fresh = generation.call_model(requests, client, "score", cache, temperature=0.0, max_tokens=max_tokens, max_concurrency=max_concurrency)
    parsed = generation.parse_replies(replies.select("sample_id", "metric", "result"), "result", "score")
    return parsed.select("sample_id", "metric", validation.clamped("score").alias("score")), fresh


def judge_validation(
    samples: DataFrame, tasks: DataFrame, client: generation.ModelClient, cache: DataFrame | None = None, max_tokens: int = 128, max_concurrency: int = 128, dry_run: bool = False
) -> tuple[DataFrame, DataFrame] | None:
    """(report, new cache rows): mean, median, least and greatest score of each dataset and metric, one row for each task.

    A dataset without samples, and a metric without a valid score, has nulls.  A dry run sends one made-up request, raises what
    the client raises, and gives None.
    """
    if dry_run:
        mock = samples.sparkSession.createDataFrame([("Mock", "Mock", "Mock", "foo")], "prompt string, chosen string, rejected string, preference string")
        request = generation.judge_request(*(F.col(c) for c in ("prompt", "chosen", "rejected", "preference")))
        client.complete(mock.select(request).first()[0], "score", 0.0, max_tokens)
        return None
    scores, fresh = judge_scores(samples, tasks, client, cache, max_tokens, max_concurrency)
    return validation.judge_report(samples, cut(scores, "scores"), tasks), fresh


class EmbeddingClient(Protocol):
    """What an embedding call needs; an instance is pickled to the workers and called from several threads of each."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector for each text, all of one length."""


class HashEmbedder:
    """A deterministic stand-in for an embedding model: eight numbers from the text's digest.  Used by tests and registered queries."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        return [[int(d[4 * k : 4 * k + 4], 16) / 65535 - 0.5 for k in range(8)] for d in digests]


def _embed(batches: Iterator[pa.RecordBatch], client: EmbeddingClient, size: int, most: int, threads: int) -> Iterator[pa.RecordBatch]:
    """Add the vector of the last column's text; requests of ``size`` texts, ``threads`` at a time."""
    with ThreadPoolExecutor(threads) as pool:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            groups = [texts[i : i + size] for i in range(0, len(texts), size)]
            vectors = [v for some in pool.map(lambda g: generation.retried(lambda: client.embed(g), most), groups) for v in some]
            if len(vectors) != len(texts):
                raise RuntimeError(f"{len(texts)} texts were sent and {len(vectors)} vectors came back")
            yield pa.record_batch([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "embedding"])


def embed_texts(rows: DataFrame, keys: list[str], text: str, client: EmbeddingClient, batch_size: int = 256, max_concurrency: int = 128, most: int | None = None) -> DataFrame:
    """(keys, embedding): the vector of each text, asked for in requests of ``batch_size`` texts; a null text counts as empty.

    At most ``max_concurrency`` requests are on their way at a time in the whole cluster.
    """
    if batch_size < 1:
        raise ValueError("a request has at least one text")
    parts, threads = generation.in_flight(rows.sparkSession, max_concurrency)
    limit = most or generation.tries()
    picked = rows.select(*keys, F.col(text).alias("_pf_text")).repartition(parts)
    kinds = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_map(picked, lambda it: _embed(it, client, batch_size, limit, threads), f"{kinds}, embedding array<double>")


def embedding_validation(samples: DataFrame, tasks: DataFrame, client: EmbeddingClient, batch_size: int = 256, max_concurrency: int = 128, dry_run: bool = False) -> DataFrame | None:
    """One row for each task: mean, median, least and greatest diversity of its prompts, chosen and rejected texts.

    A text's diversity is 1 less its mean cosine similarity to all texts of its dataset and column.  Datasets without samples have
    nulls.  The vectors are written out before use, so a repeated task sends nothing again.  A dry run embeds one empty text, raises what
    the client raises, and gives None.
    """
    if dry_run:
        client.embed([""])
        return None
    texts = validation.unpivot_texts(samples, ["dataset_idx"])
    vectors = cut(embed_texts(texts, ["dataset_idx", "text_type"], "text", client, batch_size, max_concurrency), "embeddings")
    each = validation.diversity_report(vectors, "embedding", ["dataset_idx", "text_type"])
    wide = each.groupBy("dataset_idx").agg(*(F.max(F.when(F.col("text_type") == f, F.col(s))).alias(f"{f}_{s}") for f in TEXT_FIELDS for s in STATS))
    return tasks.select("dataset_idx").join(wide, "dataset_idx", "left")
