"""Named datasets, the response-cache table, checkpoints and pluggable remote storage."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.schema import CACHE
from prefloom.sources.json_io import read_json

_named: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
    """Make a samples table known by name."""
    _named[name] = loader


def load_dataset(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A samples table from a registered name, a JSON file, a Parquet path, or a table itself; ValueError otherwise."""
    if isinstance(source, DataFrame):
        return source
    if source in _named:
        return _named[source](spark)
    if source.endswith(".json"):
        return read_json(spark, source)[0]
    if "/" in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    raise ValueError(f"unknown dataset: {source}")


def capped(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first rows of each split, at most the split's limit (splits without one are kept whole); by dataset and sample index."""
    from prefloom.operators.transforms import with_global_index

    out = None
    for name, k in limits.items():
        part = with_global_index(df.where(F.col("split") == name)).where(F.col("global_idx") < k).drop("global_idx")
        out = part if out is None else out.unionByName(part)
    rest = df.where(~F.col("split").isin(list(limits)) | F.col("split").isNull())
    return rest if out is None else out.unionByName(rest)


class CacheTable:
    """A Parquet table of model replies (key, query, result, nonce); the latest reply of a key counts."""

    def __init__(self, spark: SparkSession, path: str, refresh: bool = False) -> None:
        self.spark, self.path, self.refresh = spark, path, refresh

    def read(self) -> DataFrame:
        """The cached replies; empty before the first write, and while a refresh is forced."""
        empty = self.spark.createDataFrame([], CACHE)
        if self.refresh:
            return empty
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return empty
            raise
        latest = rows.groupBy("key").agg(F.max_by(F.struct("query", "result", "nonce"), "written").alias("r"))
        return latest.select("key", "r.*")

    def write(self, replies: DataFrame) -> None:
        """Append replies; nothing is read or rewritten, later rows win when read."""
        replies.select("key", "query", "result", "nonce").withColumn("written", F.current_timestamp()).write.mode("append").parquet(self.path)


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Paths two levels below a folder, as a table (path); file listing only, no content is read."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return spark.createDataFrame([(s.getPath().toUri().getPath(),) for s in (found or [])], "path string")


class RemoteStore(Protocol):
    """Where files come from and go to besides paths; an implementation is passed in."""

    def download(self, repository: str, filename: str) -> str: ...

    def upload(self, repository: str, path: str) -> None: ...


def fetch(store: RemoteStore | None, repository: str | None, filename: str) -> str:
    """A local path of a file, downloaded first if a repository is named."""
    if repository is None:
        return filename
    if store is None:
        raise ValueError("a remote repository needs a store")
    return store.download(repository, filename)


def push(store: RemoteStore | None, repository: str | None, path: str) -> list[str]:
    """Upload a file, or all JSON files of a folder; returns what was uploaded."""
    import os

    if repository is None:
        return []
    if store is None:
        raise ValueError("a remote repository needs a store")
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".json")) if os.path.isdir(path) else [path]
    for f in files:
        store.upload(repository, f)
    return files
