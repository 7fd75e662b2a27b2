"""Task configurations and seed-word vocabularies."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.schema import TASKS

Vocabulary = Mapping[str, list[str]]


def read_vocabulary(rows: DataFrame) -> dict[str, list[str]]:
    """A (alias, word_idx, word) table as lists in order; it is a small lookup of a few hundred words."""
    out: dict[str, list[str]] = {}
    for r in rows.where("alias is not null and word is not null").orderBy("alias", "word_idx").collect():
        out.setdefault(r["alias"], []).append(r["word"])
    return out


def seed_words(vocabulary: Vocabulary, alias: str) -> list[str]:
    """The words of an alias; ValueError if there is no such alias."""
    if alias not in vocabulary:
        raise ValueError(f"unknown seed words: {alias}")
    return list(vocabulary[alias])


def parse_component(name: str, args: Mapping | None, vocabulary: Vocabulary) -> dict:
    """A domain component; its words are its own or those of the vocabulary it names.  No arguments count as empty ones."""
    args = args or {}
    words = args.get("seed_words") or name
    words = seed_words(vocabulary, words) if isinstance(words, str) else list(words)
    if not words:
        raise ValueError(f"component {name} has no seed words")
    weight = args.get("weight")
    return {"name": name, "seed_words": [str(w) for w in words], "description": args.get("description"), "weight": None if weight is None else float(weight)}


def parse_domain(components: Mapping, vocabulary: Vocabulary) -> dict:
    """The components by name.  Weights are given for all (none negative) or for none (then all are equal)."""
    if not components:
        raise ValueError("a domain has at least one component")
    out = {name: parse_component(name, args, vocabulary) for name, args in components.items()}
    given = [c["weight"] for c in out.values() if c["weight"] is not None]
    if given and len(given) != len(out):
        raise ValueError("weights for some components only")
    if any(w < 0 for w in given):
        raise ValueError("negative weight")
    for c in out.values():
        c["weight"] = 1 / len(out) if c["weight"] is None else c["weight"]
    return out


def parse_task(task: Mapping, vocabulary: Vocabulary) -> dict:
    """A task of domain, objective and preference; KeyError if one is missing."""
    return {"domain": parse_domain(task["domain"], vocabulary), "objective": task["objective"], "preference": task["preference"]}


def tasks_table(spark: SparkSession, config: Mapping, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(dataset_idx, domain, objective, preference, num_samples) of a configuration's task_specs."""
    rows = []
    for i, spec in enumerate(config["task_specs"]):
        t = parse_task(spec["alignment_task"], vocabulary or {})
        rows.append((i, t["domain"], t["objective"], t["preference"], int(spec["num_samples"])))
    return spark.createDataFrame(rows, T.StructType([*TASKS.fields, T.StructField("num_samples", T.IntegerType())]))


def read_config(spark: SparkSession, path: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The tasks of a YAML configuration file."""
    import yaml

    return tasks_table(spark, yaml.safe_load(Path(path).read_text(encoding="utf-8")), vocabulary)


def write_config(config: Mapping, path: str, model: str, max_concurrency: int, dry_run: bool = False) -> None:
    """Keep a run's configuration beside its output; a dry run keeps nothing."""
    if not dry_run:
        Path(path).write_text(json.dumps({**config, "model": model, "max_concurrency": max_concurrency}, indent=2), encoding="utf-8")


def run_id(name: str, revision: str = "local") -> str:
    """name/date_time_revision."""
    return f"{name}/{datetime.datetime.now():%Y-%m-%d_%H-%M-%S}_{revision}"


def resolved_components(tasks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(dataset_idx, name, words, known): each component with the size of the vocabulary its name stands for.

    A component whose name is no alias has null; the vocabulary is a small lookup, joined by alias.
    """
    parts = tasks.select("dataset_idx", F.explode(F.map_values("domain")).alias("c")).select("dataset_idx", "c.name", F.size("c.seed_words").alias("words"))
    sizes = vocabulary.groupBy("alias").agg(F.count("*").alias("known"))
    return parts.join(sizes, parts["name"] == sizes["alias"], "left").select("dataset_idx", "name", "words", "known")
