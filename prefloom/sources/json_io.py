"""Dataset files: JSON as the exchange format, Parquet as the native one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.schema import CONTINUAL, DATASET, TEXT_FIELDS
from prefloom.session import arrow_map, shared_folder


def _flatten(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset_idx, d struct) to samples and tasks."""
    tag = lambda name: F.transform(F.coalesce(F.col(f"d.{name}"), F.array()), lambda x: F.struct(F.lit(name).alias("split"), *(x[c].alias(c) for c in TEXT_FIELDS)))
    samples = rows.select("dataset_idx", F.posexplode(F.concat(tag("train"), tag("test"))).alias("sample_idx", "s"))
    samples = samples.select("dataset_idx", F.col("sample_idx").cast("long"), "s.*")
    return samples, rows.select("dataset_idx", "d.task.*")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, tasks) of a file with a series of datasets, or with a single one (which gets index 0).

    The stored split is kept row by row.  A dataset without samples has a task row only.
    """
    both = CONTINUAL.fields + DATASET.fields
    from pyspark.sql.types import StructType

    raw = spark.read.schema(StructType(both)).option("multiLine", True).json(path)
    series = raw.where("datasets is not null").select(F.posexplode("datasets").alias("dataset_idx", "d"))
    single = raw.where("datasets is null").select(F.lit(0).alias("dataset_idx"), F.struct("task", "train", "test").alias("d"))
    return _flatten(series.union(single))


def json_lines(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """(dataset_idx, kind, sample_idx, text): the pieces of the document in their order.

    Kind 0 opens a dataset with its task and its train list, 1 are train samples, 2 closes that list and opens the test list, 3 are
    test samples, 4 closes the dataset.  A piece that follows another of its list, or of the list of datasets, begins with a comma;
    the first of a list has one too, which ``write_json`` leaves out.
    """
    to_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    known = tasks.select("dataset_idx", F.struct("domain", "objective", "preference").alias("task"))
    frame = F.array(
        F.struct(F.lit(0).alias("kind"), F.concat(F.lit(', {"task": '), to_json("task"), F.lit(', "train": [')).alias("text")),
        F.struct(F.lit(2).alias("kind"), F.lit('], "test": [').alias("text")),
        F.struct(F.lit(4).alias("kind"), F.lit("]}").alias("text")),
    )
    frame = known.select("dataset_idx", F.explode(frame).alias("f")).select("dataset_idx", "f.kind", F.lit(None).cast("long").alias("sample_idx"), "f.text")
    body = F.concat(F.lit(", "), to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in TEXT_FIELDS))))
    kind = F.when(F.col("split") == "train", 1).otherwise(3)
    rows = samples.where(F.col("split").isin("train", "test")).join(tasks.select("dataset_idx"), "dataset_idx", "left_semi")
    return frame.unionByName(rows.select("dataset_idx", kind.alias("kind"), F.col("sample_idx").cast("long"), body.alias("text")))


def _commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out the comma of a piece that opens a list; that of a partition's first piece is left to ``write_json``."""
    last = None
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            out.append(text[2:] if last is not None and last.endswith("[") and text.startswith(",") else text)
            last = text
        yield pa.record_batch([pa.array(out, pa.string())], ["text"])


def write_json(samples: DataFrame, tasks: DataFrame, path: str) -> None:
    """Write one JSON document to any path Spark can write.

    The pieces are sorted and written by all tasks, and the parts are joined byte by byte, so neither a task nor the driver holds
    a dataset.  Samples come by sample_idx (ties by text), train before test; samples without a task are left out.
    """
    spark = samples.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    order = ["dataset_idx", "kind", "sample_idx", "text"]
    lines = json_lines(samples, tasks)
    parts = f"{shared_folder(spark)}/prefloom-json-{uuid.uuid4().hex}"
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text")
    arrow_map(lines, _commas, "text string").write.option("lineSep", "\n").text(parts)
    target = jvm.org.apache.hadoop.fs.Path(path)
    files, source = target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(parts)
    held = source.getFileSystem(conf)
    files.setWriteChecksum(False)
    out = files.create(target, True)
    try:
        out.write(bytearray(b'{"datasets": ['))
        opened = True  # the document so far ends with the opening of a list
        for status in sorted(held.globStatus(jvm.org.apache.hadoop.fs.Path(f"{parts}/part-*")), key=lambda f: f.getPath().getName()):
            if not status.getLen():
                continue
            part = held.open(status.getPath())
            first = part.read()
            if not (opened and first == ord(",")):
                out.write(first)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.seek(status.getLen() - 2)
            opened = part.read() == ord("[")
            part.close()
        out.write(bytearray(b"]}"))
    finally:
        out.close()
        held.delete(source, True)


def write_splits(samples: DataFrame, path: str) -> None:
    """The three text columns in Parquet folders for each dataset and split."""
    samples.select("dataset_idx", "split", *TEXT_FIELDS).write.partitionBy("dataset_idx", "split").mode("overwrite").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Reports (each one row for each dataset) as one JSON object of lists in order of datasets; a row without any value is null."""
    out = {}
    for name, report in reports.items():
        rows = [r.asDict(recursive=True) for r in report.orderBy("dataset_idx").collect()]
        plain = [{k: v for k, v in r.items() if k != "dataset_idx"} for r in rows]
        out[name] = [r if any(v is not None for v in r.values()) else None for r in plain]
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")
