"""Command line: generate, validate, transform, sample, merge, preview.

python -m prefloom.cli COMMAND --help
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prefloom.operators import generation, model_reports, transforms, validation
from prefloom.session import cut, local_session
from prefloom.sources import json_io, registry, tasks


def setup_logging(path: str | None = None) -> None:
    """INFO to the terminal, DEBUG appended to a file; warns once the file exceeds 500 MB."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    handlers[0].setLevel(logging.INFO)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, mode="a"))
    logging.basicConfig(level=logging.DEBUG if path else logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if path and Path(path).stat().st_size > 500e6:
        logging.warning("the log file %s exceeds 500 MB", path)


def _between(low: float, high: float, kind: type = int):
    """An argument clamped to a range."""
    return lambda text: min(high, max(low, kind(text)))


def _client(given, model: str | None, stand_in):
    """The client passed in; without one only the model 'hash' is known."""
    if given is None and model != "hash":
        raise SystemExit(f"no client for model {model!r}: pass one to main(), or name the stand-in 'hash'")
    return given or stand_in()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prefloom", description=__doc__.splitlines()[0])
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="generate a series from a task configuration")
    g.add_argument("config")
    g.add_argument("output")
    g.add_argument("--vocabulary", help="Parquet table (alias, word_idx, word)")
    g.add_argument("--model", required=True, help="a model of the client passed in, or 'hash', which makes up replies from digests")
    g.add_argument("--temperature", type=_between(0.0, 2.0, float), default=0.99)
    g.add_argument("--max-concurrency", type=_between(1, 256), default=128)
    g.add_argument("--max-tokens-prompt-response", type=_between(1, 32768), default=1024)
    g.add_argument("--max-tokens-chosen-rejected-response", type=_between(1, 65536), default=2048)
    g.add_argument("--cache", help="Parquet folder of model replies")
    g.add_argument("--hub-repository", help="send the result to this repository of the store passed in")
    g.add_argument("--include-preference-axes", action="store_true")
    g.add_argument("--dry-run", action="store_true")
    g.add_argument("--random-seed", type=int, default=0)
    v = sub.add_parser("validate", help="quality reports of a series")
    v.add_argument("input")
    v.add_argument("output")
    v.add_argument("--no-count", action="store_true")
    v.add_argument("--no-entropy", action="store_true")
    v.add_argument("--llm-judge", action="store_true")
    v.add_argument("--embedding-diversity", action="store_true")
    v.add_argument("--model", help="judge: a model of the client passed in, or 'hash'")
    v.add_argument("--embedding-model", help="a model of the embedder passed in, or 'hash'")
    v.add_argument("--embedding-batch-size", type=int, default=256)
    v.add_argument("--max-concurrency", type=_between(1, 256), default=128)
    v.add_argument("--max-tokens-judge-response", type=_between(1, 1024), default=128)
    v.add_argument("--cache", help="Parquet folder of judge replies")
    v.add_argument("--dry-run", action="store_true", help="ask the models about one made-up sample only")
    v.add_argument("--hub-repository", help="take the input from, and send the report to, this repository of the store passed in")
    t = sub.add_parser("transform", help="swap preferences or split")
    t.add_argument("kind", choices=("preference_swap", "split"))
    t.add_argument("input")
    t.add_argument("output")
    t.add_argument("value", type=float, help="swap probability or test ratio")
    t.add_argument("--random-seed", type=int, default=0)
    s = sub.add_parser("sample", help="downsample each dataset's splits")
    s.add_argument("input")
    s.add_argument("output")
    for split in ("train", "test"):
        s.add_argument(f"--keep-ratio-{split}", type=float, default=1.0)
        s.add_argument(f"--keep-amount-{split}", type=int)
    s.add_argument("--random-seed", type=int, default=0)
    m = sub.add_parser("merge", help="one series of several")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--output", required=True)
    w = sub.add_parser("preview", help="show one sample")
    w.add_argument("input")
    w.add_argument("--dataset", type=int, default=0)
    w.add_argument("--split", choices=("train", "test"), default="train")
    w.add_argument("--at", type=int, default=0)
    w.add_argument("--no-shuffle", action="store_true")
    return p


def validate(a: argparse.Namespace, spark: SparkSession, client: generation.ModelClient | None, embedder: model_reports.EmbeddingClient | None, store: registry.RemoteStore | None) -> int:
    """Write the chosen reports as one JSON object of lists, one entry a dataset; an empty dataset has null from the models."""
    samples, series = json_io.read_json(spark, registry.fetch(store, a.hub_repository, a.input))
    samples = cut(samples, "samples")
    if a.dry_run:
        if a.llm_judge:
            model_reports.judge_validation(samples, series, _client(client, a.model, generation.HashClient), dry_run=True)
        if a.embedding_diversity:
            model_reports.embedding_validation(samples, series, _client(embedder, a.embedding_model, model_reports.HashEmbedder), dry_run=True)
        logging.info("dry run: a success")
        return 0
    reports = {}
    if not a.no_count:
        reports["count_validation"] = validation.count_validation(samples, series)
    if not a.no_entropy:
        reports["entropy_validation"] = validation.entropy_validation(samples, series)
    if a.llm_judge:
        cache = registry.CacheTable(spark, a.cache) if a.cache else None
        keyed = samples.withColumn("sample_id", F.struct("dataset_idx", "sample_idx", "split"))
        report, fresh = model_reports.judge_validation(keyed, series, _client(client, a.model, generation.HashClient), cache and cache.read(), a.max_tokens_judge_response, a.max_concurrency)
        if cache:
            cache.write(fresh)
        reports["llm_judge_validation"] = report
    if a.embedding_diversity:
        reports["llm_embedding_diversity"] = model_reports.embedding_validation(samples, series, _client(embedder, a.embedding_model, model_reports.HashEmbedder), a.embedding_batch_size, a.max_concurrency)
    if not reports:
        logging.warning("no validation measure was chosen")
        return 0
    json_io.write_reports(reports, a.output)
    registry.push(store, a.hub_repository, a.output)
    return 0


def main(
    argv: list[str] | None = None, spark: SparkSession | None = None, client: generation.ModelClient | None = None,
    embedder: model_reports.EmbeddingClient | None = None, store: registry.RemoteStore | None = None,
) -> int:
    a = parser().parse_args(argv)
    setup_logging(a.log_file)
    spark = spark or local_session()
    if a.command == "validate":
        return validate(a, spark, client, embedder, store)
    if a.command == "generate":
        model = _client(client, a.model, generation.HashClient)
        words = tasks.read_vocabulary(spark.read.parquet(a.vocabulary)) if a.vocabulary else {}
        wanted = tasks.read_config(spark, a.config, words)
        cache = registry.CacheTable(spark, a.cache) if a.cache else None
        samples, fresh = generation.generate(
            wanted, model, cache=cache and cache.read(), seed=a.random_seed, temperature=a.temperature, include_axes=a.include_preference_axes, dry_run=a.dry_run,
            max_tokens=(a.max_tokens_prompt_response, a.max_tokens_chosen_rejected_response), max_concurrency=a.max_concurrency,
        )
        if a.dry_run:
            logging.info("dry run: %s", samples.count())
            return 0
        json_io.write_json(samples, wanted, a.output)
        if cache:
            cache.write(fresh)
        import yaml

        tasks.write_config(yaml.safe_load(Path(a.config).read_text(encoding="utf-8")), str(Path(a.output).with_suffix(".config.json")), a.model, a.max_concurrency)
        registry.push(store, a.hub_repository, a.output)
        return 0
    if a.command == "merge":
        parts = [json_io.read_json(spark, i) for i in a.inputs]
        shift = 0
        all_tasks = None
        for (_, t) in parts:
            moved = t.withColumn("dataset_idx", t["dataset_idx"] + shift)
            shift += t.count()
            all_tasks = moved if all_tasks is None else all_tasks.unionByName(moved)
        shift = 0
        merged = None
        for samples, t in parts:
            moved = samples.withColumn("dataset_idx", samples["dataset_idx"] + shift)
            shift += t.count()
            merged = moved if merged is None else merged.unionByName(moved)
        json_io.write_json(merged, all_tasks, a.output)
        return 0
    samples, series = json_io.read_json(spark, a.input)
    if a.command == "transform":
        out = transforms.split(samples, a.value) if a.kind == "split" else transforms.preference_swap(samples, a.value, a.random_seed)
        json_io.write_json(out, series, a.output)
    elif a.command == "sample":
        out = transforms.stratified_sample(samples, a.keep_ratio_train, a.keep_ratio_test, a.keep_amount_train, a.keep_amount_test, a.random_seed)
        json_io.write_json(out.drop("sample_order"), series, a.output)
    elif a.command == "preview":
        row = transforms.preview(samples, a.dataset, a.split, a.at, not a.no_shuffle).first()
        print("No data available!" if row is None else "\n\n".join(f"{k}: {row[k]}" for k in ("prompt", "chosen", "rejected")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
