import json

import pytest
from pyspark.sql import functions as F

from prefloom import cli
from prefloom.operators import metrics as M
from prefloom.schema import CACHE
from prefloom.sources import json_io, registry, tasks
from prefloom.streaming import ingest

DOMAIN = {"A": {"name": "A", "seed_words": ["a", "b"], "description": None, "weight": 1.0}}


@pytest.fixture
def series(tmp_path):
    sample = lambda i: {"prompt": f"p {i}", "chosen": f"a longer chosen answer {i}", "rejected": f"a longer rejected answer {i}"}
    task = {"domain": DOMAIN, "objective": "o", "preference": "p"}
    data = {"datasets": [{"task": task, "train": [sample(i) for i in range(k)], "test": [sample(i) for i in range(k, 3)]} for k in (3, 1)] + [{"task": task, "train": [], "test": []}]}
    path = tmp_path / "series.json"
    path.write_text(json.dumps(data))
    return data, str(path), tmp_path


def test_json_round_trip(spark, series):
    data, path, tmp = series
    s, t = json_io.read_json(spark, path)
    assert s.count() == 6 and t.count() == 3
    assert [(r.split, r.sample_idx) for r in s.where("dataset_idx = 1").orderBy("sample_idx").collect()] == [("train", 0), ("test", 1), ("test", 2)]
    json_io.write_json(s, t, str(tmp / "out.json"))
    assert json.loads((tmp / "out.json").read_text()) == data


def test_single_dataset_json(spark, series):
    data, _, tmp = series
    one = tmp / "one.json"
    one.write_text(json.dumps(data["datasets"][1]))
    s, t = json_io.read_json(spark, str(one))
    assert s.count() == 3 and t.first().dataset_idx == 0 and t.first().domain["A"]["seed_words"] == ["a", "b"]


def test_splits_and_reports(spark, series):
    _, path, tmp = series
    s, _ = json_io.read_json(spark, path)
    json_io.write_splits(s, str(tmp / "splits"))
    back = json_io.read_splits(spark, str(tmp / "splits"))
    assert back.where("dataset_idx = 1 and split = 'test'").count() == 2
    report = spark.createDataFrame([(1, None), (0, 2.0)], "dataset_idx int, x double")
    json_io.write_reports({"r": report, "none": report.limit(0)}, str(tmp / "r.json"))
    assert json.loads((tmp / "r.json").read_text()) == {"r": [{"x": 2.0}, None], "none": []}


def test_json_of_many_parts(spark, tmp_path):
    """A dataset that is longer than a part, empty datasets and lists, ties, and marks that look like the document's own."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(1, i % 700, "train" if i % 3 else "test", f'[{i}', ', "x": [', "]}[") for i in range(1000)] + [(3, 0, "test", "p", None, "r"), (9, 0, "train", "no task", "c", "r"), (1, 5, "dev", "p", "c", "r")]
        s = spark.createDataFrame(rows, "dataset_idx int, sample_idx long, split string, prompt string, chosen string, rejected string")
        t = spark.createDataFrame([(i, {"A": ("A", ["a"], None, 1.0)}, f"o{i}", None) for i in range(4)], "dataset_idx int, domain map<string,struct<name:string,seed_words:array<string>,description:string,weight:double>>, objective string, preference string")
        json_io.write_json(s, t, str(tmp_path / "x.json"))
        got = json.loads((tmp_path / "x.json").read_text())["datasets"]
        plain = lambda d, split: [{"prompt": r[3], "chosen": r[4] or "", "rejected": r[5]} for r in sorted((r for r in rows if r[0] == d and r[2] == split), key=lambda r: (r[1], r[3]))]
        assert [d["task"]["objective"] for d in got] == ["o0", "o1", "o2", "o3"]
        assert all(got[d][split] == plain(d, split) for d in range(4) for split in ("train", "test"))
        json_io.write_json(s.limit(0), t.limit(0), str(tmp_path / "y.json"))
        assert json.loads((tmp_path / "y.json").read_text()) == {"datasets": []}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_command_line(spark, series):
    _, path, tmp = series
    out = lambda n: str(tmp / n)
    assert cli.main(["validate", path, out("report.json")], spark) == 0
    report = json.loads((tmp / "report.json").read_text())
    assert [r["sample"] for r in report["count_validation"]] == [3, 3, 0] and report["entropy_validation"][2]["prompt_entropy"] == 0
    models = ["--llm-judge", "--embedding-diversity", "--max-concurrency", "4", "--embedding-batch-size", "2"]
    with pytest.raises(SystemExit):
        cli.main(["validate", path, out("x.json"), *models], spark)
    named = [*models, "--model", "hash", "--embedding-model", "hash", "--no-count", "--no-entropy"]
    assert cli.main(["validate", path, out("models.json"), *named, "--cache", out("cache")], spark) == 0
    report = json.loads((tmp / "models.json").read_text())
    assert [r and len(r) for r in report["llm_judge_validation"]] == [r and len(r) for r in report["llm_embedding_diversity"]] == [12, 12, None]
    assert registry.CacheTable(spark, out("cache")).read().count() > 0
    assert cli.main(["validate", path, out("none.json"), *named, "--dry-run"], spark) == 0 and not (tmp / "none.json").exists()
    cli.main(["transform", "preference_swap", path, out("swap.json"), "1"], spark)
    assert json.loads((tmp / "swap.json").read_text())["datasets"][0]["train"][0]["chosen"] == "a longer rejected answer 0"
    with pytest.raises(ValueError):
        cli.main(["transform", "split", path, out("x.json"), "0.5"], spark)
    cli.main(["sample", path, out("less.json"), "--keep-amount-train", "1", "--keep-ratio-test", "0.5"], spark)
    less = json.loads((tmp / "less.json").read_text())["datasets"]
    assert [(len(d["train"]), len(d["test"])) for d in less] == [(1, 0), (1, 1), (0, 0)]
    cli.main(["merge", path, path, "--output", out("both.json")], spark)
    assert len(json.loads((tmp / "both.json").read_text())["datasets"]) == 6
    cli.main(["preview", path, "--no-shuffle"], spark)


def test_generate_command(spark, tmp_path):
    import yaml

    config = {"task_specs": [{"num_samples": 2, "alignment_task": {"objective": "o", "preference": "p", "domain": {"A": {"seed_words": ["a", "b"]}}}}]}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    cli.main(["generate", str(tmp_path / "c.yaml"), str(tmp_path / "out.json"), "--max-concurrency", "2", "--model", "hash"], spark)
    with pytest.raises(SystemExit):
        cli.main(["generate", str(tmp_path / "c.yaml"), str(tmp_path / "y.json"), "--model", "unknown"], spark)
    assert not (tmp_path / "y.json").exists()
    assert len(json.loads((tmp_path / "out.json").read_text())["datasets"][0]["train"]) == 2
    assert json.loads((tmp_path / "out.config.json").read_text())["max_concurrency"] == 2


def test_cache_table(spark, tmp_path):
    c = registry.CacheTable(spark, str(tmp_path / "cache"))
    assert c.read().count() == 0
    c.write(spark.createDataFrame([("k", "q", "a", None)], CACHE))
    c.write(spark.createDataFrame([("k", "q", "b", "1")], CACHE))
    assert [r.result for r in c.read().collect()] == ["b"]
    assert registry.CacheTable(spark, str(tmp_path / "cache"), refresh=True).read().count() == 0


def test_registry(spark, samples, series, tmp_path):
    _, path, _ = series
    s = samples([(0, i, "train" if i < 4 else "test", "p", "c", "r") for i in range(6)])
    registry.register("mine", lambda _: s)
    assert registry.load_dataset(spark, "mine").count() == 6 and registry.load_dataset(spark, s) is s
    assert registry.load_dataset(spark, path).count() == 6
    with pytest.raises(ValueError):
        registry.load_dataset(spark, "nothing")
    assert registry.capped(s, {"train": 2, "test": 9}).count() == 4
    (tmp_path / "ck" / "a" / "checkpoint-200").mkdir(parents=True)
    (tmp_path / "ck" / "a" / "checkpoint-1000").mkdir()
    (tmp_path / "ck" / "a" / "logs").mkdir()
    order = [r.checkpoint for r in M.checkpoint_order(registry.checkpoints(spark, str(tmp_path / "ck"))).collect()]
    assert order == ["checkpoint-1000", "checkpoint-200"]


def test_remote_store(tmp_path):
    class Store:
        def __init__(self):
            self.sent = []

        def download(self, repository, filename):
            return f"/got/{repository}/{filename}"

        def upload(self, repository, path):
            self.sent.append(path)

    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.txt").write_text("")
    s = Store()
    assert registry.fetch(s, "r", "f") == "/got/r/f" and registry.fetch(None, None, "f") == "f"
    assert len(registry.push(s, "r", str(tmp_path))) == 1 and registry.push(s, None, "x") == []
    with pytest.raises(ValueError):
        registry.fetch(None, "r", "f")


def test_run_id():
    import re

    assert re.fullmatch(r"x/\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d_abc", tasks.run_id("x", "abc"))


def test_streaming_ingest_writes_once(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    batch = spark.read.parquet(f"{sf_dir}/samples.parquet")
    batch.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    q = ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), late="4000 days")
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.select("sample_id").distinct().count()
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), late="4000 days").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()


def test_metrics(spark):
    m = spark.createDataFrame([("eval", "t", True, "k", 1.0), ("eval", None, False, "k", 3.0), ("train", "t", False, "k", 5.0)], "split string, task string, is_final boolean, key string, value double")
    assert {r.key: r.value for r in M.metric_rollup(m).where("split <> 'train'").collect()} == {"k": 2.0, "task/t/k": 3.0, "eval.last/eval.last/k".removeprefix("eval.last/"): 1.0}
    s = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "dataset_idx int, row_idx long, score double")
    assert M.mean_eval_reward(s, 2).first().mean_reward == 1.5
    assert M.mean_eval_reward(s, 9).first().mean_reward is None
    f = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0)], "name string, value double")
    assert [r.name for r in M.top_importance(f, 2).collect()] == ["c", "a"]
    e = M.drift_penalty(*(spark.createDataFrame([("w", 0, v)], f"name string, idx int, {c} double") for c, v in (("value", 2.0), ("theta", 1.0), ("theta", 4.0))), 0.5)
    assert e.first().penalty == 0.25 * 2 * 9
    assert M.prefixed(spark.createDataFrame([(3, "k")], "dataset_idx int, key string")).first().key == "dataset-3/k"


def test_checks_of_registered_queries(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, columns in (("valid_replies", ["score_id", "parsed"]), ("axes_prompts", ["sample_id", "request_0", "request_1"]), ("slice_negative", ["dataset_idx", "sample_idx", "global_idx"])):
        df = entry.queries()[name](spark, sf_dir)
        assert df.columns == columns and not df.isEmpty()
