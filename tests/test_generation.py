import json
import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.operators import generation as G
from prefloom.sources import tasks as T

CONFIG = {
    "task_specs": [
        {"num_samples": 5, "alignment_task": {"objective": "write", "preference": "be brief", "domain": {"A": {"seed_words": ["a", "b", "c"]}, "B": {"seed_words": ["d", "e", "f"]}}}},
        {"num_samples": 5, "alignment_task": {"objective": "sing", "preference": "be long", "domain": {"A": {"seed_words": ["a", "b", "c"], "weight": 3}, "B": {"seed_words": ["d"], "weight": 1}}}},
    ]
}


class Client(G.HashClient):
    """Malformed replies where the request's hash says so; scores are fixed."""

    def __init__(self, bad="", score=1):
        self.bad, self.score = bad, score

    def complete(self, request, schema, temperature, max_tokens):
        if schema == self.bad:
            return '{"foo": 1}'
        if schema == "score":
            return json.dumps({"score": self.score})
        return super().complete(request, schema, temperature, max_tokens)


class Failing(G.HashClient):
    def complete(self, request, schema, temperature, max_tokens):
        raise G.RateLimited


def table(spark, config=CONFIG, words=None):
    return T.tasks_table(spark, config, words)


def test_generate(spark):
    s, kept = G.generate(table(spark), Client(), max_concurrency=2)
    got = s.collect()
    assert Counter(r.dataset_idx for r in got) == {0: 5, 1: 5} and {r.sample_idx for r in got} == set(range(5))
    assert 15 <= kept.count() <= 20  # equal requests are sent once
    again, more = G.generate(table(spark), Client(), cache=kept, max_concurrency=2)
    assert more.count() == 0 and sorted(again.collect()) == sorted(got)


def test_malformed_replies_give_no_sample(spark):
    assert G.generate(table(spark), Client("pair"), max_concurrency=2)[0].count() == 0
    assert G.generate(table(spark), Client("prompt"), max_concurrency=2)[0].count() == 0


def test_axes_and_judge(spark):
    keep = {tuple(r)[:2]: (r.chosen, r.rejected) for r in G.generate(table(spark), Client(score=1), include_axes=True, max_concurrency=2)[0].collect()}
    swap = {tuple(r)[:2]: (r.rejected, r.chosen) for r in G.generate(table(spark), Client(score=0), include_axes=True, max_concurrency=2)[0].collect()}
    assert keep == swap and len(keep) == 10


def test_dry_run_and_failures(spark, monkeypatch):
    assert G.generate(table(spark), Client(), dry_run=True, max_concurrency=1)[0].count() == 1
    monkeypatch.setenv("BACKOFF_UNIT", "0")
    with pytest.raises(Exception, match="RateLimited"):
        G.generate(table(spark), Failing(), max_concurrency=1)[0].count()
    assert pickle.loads(pickle.dumps(Client()))


def test_templates(spark):
    r = spark.range(1).select(G.prompt_request(F.lit("OBJ"), F.array(F.lit("x"), F.lit("y")), "SUF").alias("p"), G.response_request(F.lit("PR"), F.lit("PREF")).alias("r"), G.judge_request(F.lit("P"), F.lit("C"), F.lit("R"), F.lit("F")).alias("j"), G.coherence_request(F.lit("C")).alias("c")).first()
    assert '"OBJ"' in r.p and "words: x,y." in r.p and r.p.endswith("SUF") and not r.p.startswith(" ")
    assert "'PR'" in r.r and "'PREF'" in r.r
    assert "Response 1: C\n" in r.j and "Preference: F\n" in r.j and "Statement: C\n" in r.c


def test_axes_requests(spark):
    ids = spark.range(300)
    both = ids.select("id", *(G.axes_request(F.lit("PR"), F.lit("PREF"), k, 1, "id").alias(f"p{k}") for k in (0, 1))).collect()
    score = lambda t: [line[-1] for line in t.split("\n") if "On a scale" in line]
    assert all(len(score(r.p0)) == 3 and score(r.p0) == score(r.p1) for r in both)
    share = np.mean(["must follow" in r.p0 for r in both])
    assert 0.7 < share < 0.9 and not any("must follow" in r.p1 for r in both)
    with pytest.raises(ValueError):
        G.axes_request(F.lit("a"), F.lit("b"), 2, 1)


def test_seed_words_follow_their_odds(spark):
    t = table(spark)
    req = t.select("dataset_idx", F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("prompt_idx")).where("dataset_idx = 1")
    first = Counter(r.seed_words[0] for r in G.draw_seed_words(t, req, 1, 3).collect())
    for w, p in (("a", 0.25), ("b", 0.25), ("c", 0.25), ("d", 0.25)):
        assert abs(first[w] / 3000 - p) < 0.04
    two = G.draw_seed_words(t, req, 2, 3).collect()
    assert all(len(r.seed_words) == 2 for r in two)
    with pytest.raises(ValueError):
        G.draw_seed_words(t, req, 0)
    zero = {"task_specs": [{"num_samples": 1, "alignment_task": {"objective": "o", "preference": "p", "domain": {"A": {"seed_words": ["a"], "weight": 1}, "B": {"seed_words": ["b"], "weight": 0}}}}]}
    with pytest.raises(ValueError):
        G.draw_seed_words(table(spark, zero), req, 2)


@pytest.mark.parametrize(
    ("reply", "schema", "want"),
    [
        ('{"score": 5}', "score", {"score": 5}), ('{"score": 5.0}', "score", {"score": 5}), ('{"score": "5"}', "score", {"score": 5}),
        ('{"score": true}', "score", {"score": 1}), ('{"score": 5.5}', "score", None), ('{"score": "Bad"}', "score", None), ('{"foo": 1}', "score", None),
        ('{"score": 5, "x": 1}', "score", None), ('{"score": null}', "score", None), ("text", "score", None), (None, "score", None),
        ('{"prompt": "a"}', "prompt", {"prompt": "a"}), ('{"prompt": 5}', "prompt", None), ('{"prompt": null}', "prompt", None), ("[]", "prompt", None),
        ('{"chosen": "a", "rejected": "b"}', "pair", {"chosen": "a", "rejected": "b"}), ('{"chosen": "a"}', "pair", None),
    ],
)
def test_replies(reply, schema, want):
    assert G.parse_reply(reply, schema) == want


def test_domains():
    words = {"education": ["x", "y"], "technology": ["z"]}
    assert [c["weight"] for c in T.parse_domain({"A": {"seed_words": ["a"]}, "B": {"seed_words": ["b"]}, "C": {"seed_words": ["c"]}}, {}).values()] == [1 / 3] * 3
    d = T.parse_domain({"education": {"weight": 0.7}, "technology": {"weight": 0.3}}, words)
    assert d["education"]["seed_words"] == ["x", "y"] and d["technology"]["weight"] == 0.3
    assert T.parse_domain({"education": None}, words)["education"]["seed_words"] == ["x", "y"]
    for bad in ({}, {"A": {"seed_words": ["a"], "weight": -1}}, {"A": {"seed_words": ["a"], "weight": 1}, "B": {"seed_words": ["b"]}}, {"none": {}}, {"A": {"seed_words": []}}):
        with pytest.raises(ValueError):
            T.parse_domain(bad, words)
    with pytest.raises(KeyError):
        T.parse_task({"objective": "o", "preference": "p"}, {})


def test_cache_upsert(spark):
    from prefloom.schema import CACHE

    old = spark.createDataFrame([("k", "q", "old", None), ("l", "r", "keep", None)], CACHE)
    new = spark.createDataFrame([("k", "q", "new", None), ("k", "q", "new", None)], CACHE)
    assert {r.key: r.result for r in G.cache_upsert(old, new).collect()} == {"k": "new", "l": "keep"}
