"""Schemas of the data model: samples, tasks, datasets, model replies, cache."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("prompt", "chosen", "rejected")])
COMPONENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("seed_words", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
TASK = T.StructType(
    [T.StructField("domain", T.MapType(T.StringType(), COMPONENT)), T.StructField("objective", T.StringType()), T.StructField("preference", T.StringType())]
)
DATASET = T.StructType([T.StructField("task", TASK), T.StructField("train", T.ArrayType(SAMPLE)), T.StructField("test", T.ArrayType(SAMPLE))])
CONTINUAL = T.StructType([T.StructField("datasets", T.ArrayType(DATASET))])

#: One row for each sample of a series of datasets; the index is the place in time, the split is stored.
SAMPLES = T.StructType(
    [T.StructField("dataset_idx", T.IntegerType()), T.StructField("sample_idx", T.LongType()), T.StructField("split", T.StringType()), *SAMPLE.fields]
)
#: One row for each dataset; ``train_frac`` is what positional splits use.
TASKS = T.StructType([T.StructField("dataset_idx", T.IntegerType()), *TASK.fields])
CACHE = T.StructType([T.StructField(c, T.StringType(), c not in ("key", "query")) for c in ("key", "query", "result", "nonce")])
TEXT_FIELDS = ("prompt", "chosen", "rejected")
