"""Session helpers: a local session for tests and tools, and shared scratch tables.

Scratch tables cut lineage.  They live in the folder the cluster names in
``spark.checkpoint.dir`` so that every executor can read them after another one is lost;
only where that setting is empty (tests, a laptop) a local temporary folder is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_paths: dict[int, tuple] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prefloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir``, else a local one set here."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="prefloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may be gone at exit
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The result has no lineage, knows its size on disk (so Spark's own size check decides
    about broadcasts) and outlives lost executors.  The table goes with ``drop``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prefloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path)
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that nothing reads any more."""
    held = _paths.get(id(df))
    if held and held[0]() is df:
        delete(df.sparkSession, held[1])


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="prefloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "prefloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))  # the driver serves it to the executors
    _shipped.add(app)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int = 0, limit: int = 64 << 20) -> DataFrame:
    """Mark a cut table for broadcast if its rows, counted with their real lengths, fit ``limit`` bytes; else leave the join to shuffle.

    ``row_bytes`` is a row's size where that is known to be more.
    """
    from pyspark.sql import functions as F

    long = [c for c, t in df.dtypes if t in ("string", "binary")]
    per = 32 + 16 * len(df.columns)
    held = df.agg(F.count("*"), *(F.sum(F.octet_length(c)) for c in long)).first()
    return F.broadcast(df) if max(held[0] * max(per, row_bytes), sum(x or 0 for x in held[1:]) + held[0] * per) <= limit else df
