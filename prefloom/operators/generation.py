"""Rendering generation and judging prompts, and running model calls behind a response cache."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions.rng import draw_int, hash_uniform
from prefloom.functions.text import cache_key
from prefloom.session import arrow_map, cut

# The prompts' wording.
ETHICS = "Ensure that the generated response adheres to ethical practices, avoids biases, and respects the target audience's needs.\n"
PROMPT_TEXT = (
    "Generate a text that fulfills the objective below.\n",
    'Do exactly what the objective says: "',
    '".\nThe description must include the following seed words: ',
    '.\nDo not include any meta commentary, instructions, or extra text (e.g., avoid phrases like "User asks" or additional context).\n'
    "The output should be clear and self-contained.\n"
    'You don\'t need to start by saying "prompt:".\n' + ETHICS + "\n",
)
RESPONSE_TEXT = (
    "Generate a 'chosen' and 'rejected' response pair to the following prompt: '",
    "'.\nThe 'chosen' response should respond to the prompt according to the following preference: '",
    "'.\nThe 'rejected' response should still respond to the prompt according to the preference but negligibly worse in its quality,\n"
    "however still close to the chosen response so it confuses the reader which one is actually better.\n"
    "Consider exactly the same style and lengths for the chosen and rejected please.\n"
    'You don\'t need to start your response by saying "here is the response" nor to give any meta-explanation. Just provide the response.\n',
)
AXES = (
    ("short", "long"),
    ("formal", "casual"),
    ("helpful", "harmful"),
    ("expert", "eli5"),
    ("direct", "hinted"),
    ("authoritative", "tentative"),
    ("friendly", "distance"),
    ("optimistic", "pessimistic"),
    ("serious", "humorous"),
    ("respectful", "disrespectful"),
    ("complex", "simple"),
    ("neutral", "biased"),
    ("detailed", "abstract"),
)
AXES_DRAWN, INCLUDE_PREFERENCE = 3, 0.8
AXES_PAD = " " * 12
JUDGE_TEXT = (
    'Please evaluate whether "response 1" is more aligned with the "prompt", compared to "response 2" according to the following preference.Preference: ',
    '\nRespond with "1" if "response 1" is more aligned, and "0" if "response 2" is more aligned.Prompt: ',
    "\nResponse 1: ",
    "\nResponse 2: ",
    "\nAlignment (1 or 0):",
)
COHERENCE_TEXT = (
    "Please evaluate the coherence of the following statement on a discrete integer scale from 0 to 10, "
    "where 10 indicates excellent coherence and 0 indicates poor coherence:\n\nStatement: ",
    "\n\nCoherence Score (0 to 10):",
)


def _fill(parts: tuple[str, ...], *values: Column) -> Column:
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [F.coalesce(value, F.lit("")), F.lit(part)]
    return F.concat(*out)


def prompt_request(objective: Column, seed_words: Column, suffix: str = "") -> Column:
    """The request that makes a model write a prompt; seed words are joined by commas."""
    head = F.concat(F.lit(PROMPT_TEXT[0]), F.lit(PROMPT_TEXT[1]))
    return F.concat(head, F.coalesce(objective, F.lit("")), F.lit(PROMPT_TEXT[2]), F.array_join(seed_words, ","), F.lit(PROMPT_TEXT[3] + suffix))


def response_request(prompt: Column, preference: Column, suffix: str = "") -> Column:
    """The request for a chosen and a rejected response."""
    return F.concat(_fill(RESPONSE_TEXT, prompt, preference), F.lit(suffix))


def axes_request(prompt: Column, preference: Column, parity: int, seed: int, *keys: Column | str, suffix: str = "") -> Column:
    """The request for one response on three drawn axes.

    Both requests of a pair (parity 0 and 1) share their three scores (1 to 5) and draw their axes separately; the
    preference is included with probability 0.8, negated for parity 1.
    """
    if parity not in (0, 1):
        raise ValueError("parity is 0 or 1")
    ranked = F.array_sort(F.array(*(F.struct(hash_uniform(f"{seed}-axis-{parity}-{i}", *keys).alias("u"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high) in enumerate(AXES))))
    lines = [
        F.concat(
            F.lit("On a scale of 1 to 2 where 1 is "), ranked[i]["low"], F.lit(" and 2 is "), ranked[i]["high"], F.lit(", your response should be: "),
            draw_int(hash_uniform(f"{seed}-score-{i}", *keys), 1, 5).cast("string"), F.lit("\n"),
        )
        for i in range(AXES_DRAWN)
    ]
    word = "must follow" if parity == 0 else "must not respect"
    wish = F.concat(F.lit(f"Your response {word} this preference overall: PREFERENCE: "), F.coalesce(preference, F.lit("")), F.lit("\n"))
    wish = F.when(hash_uniform(f"{seed}-include-{parity}", *keys) < F.lit(INCLUDE_PREFERENCE), wish).otherwise(F.lit(""))
    return F.concat(
        F.lit(AXES_PAD + "Generate a response to the following prompt: '"), F.coalesce(prompt, F.lit("")), F.lit("'.\n" + AXES_PAD), wish, F.lit(" and\n" + AXES_PAD), *lines,
        F.lit("Please ensure your responses aligns with the provided scores.'\n" + AXES_PAD),
        F.lit('You don\'t need to start your response by saying "here is the response" nor to give any meta-explanation. Just provide the response.\n' + suffix),
    )


def judge_request(prompt: Column, chosen: Column, rejected: Column, preference: Column) -> Column:
    return _fill(JUDGE_TEXT, preference, prompt, chosen, rejected)


def coherence_request(response: Column) -> Column:
    return _fill(COHERENCE_TEXT, response)


def judge_requests(samples: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, request): three requests for each sample."""
    joined = samples.join(tasks.select("dataset_idx", "preference"), "dataset_idx")
    request = F.create_map(
        F.lit("alignment"), judge_request(F.col("prompt"), F.col("chosen"), F.col("rejected"), F.col("preference")),
        F.lit("coherence_chosen"), coherence_request(F.col("chosen")),
        F.lit("coherence_rejected"), coherence_request(F.col("rejected")),
    )
    return joined.select(*keys, F.explode(request).alias("metric", "request"))


def seed_word_odds(tasks: DataFrame) -> DataFrame:
    """(dataset_idx, place, word, odds): every seed word with its chance of being drawn first.

    A component's share is its weight over all weights (one over the number of components where no weight is
    given, a missing single weight counting as one), spread evenly over its words.  Components are taken in order of their names.
    """
    entries = F.array_sort(F.map_entries("domain"))
    rows = tasks.select("dataset_idx", F.posexplode(entries).alias("c", "e"))
    rows = rows.select("dataset_idx", "c", F.coalesce("e.value.weight", F.lit(1.0)).alias("weight"), "e.value.seed_words")
    total = rows.groupBy("dataset_idx").agg(F.sum("weight").alias("total"))
    words = rows.join(total, "dataset_idx").select("dataset_idx", "c", "weight", "total", F.size("seed_words").alias("n"), F.posexplode("seed_words").alias("i", "word"))
    return words.select("dataset_idx", (F.col("c") * 100000 + F.col("i")).alias("place"), "word", (F.col("weight") / F.col("total") / F.col("n")).alias("odds"))


def draw_seed_words(tasks: DataFrame, requests: DataFrame, size: int = 2, seed: int = 0) -> DataFrame:
    """(dataset_idx, prompt_idx, seed_words): words drawn without replacement by their odds, repeats dropped, sorted.

    ``requests`` has dataset_idx and prompt_idx.  Words are ordered by -ln(u) / odds, which draws them one after another
    in proportion to their odds (Efraimidis and Spirakis).  Words without weight are never drawn; ValueError if a task has
    fewer weighted words than asked for.
    """
    if size <= 0:
        raise ValueError("at least one seed word is drawn")
    odds = seed_word_odds(tasks)
    short = odds.groupBy("dataset_idx").agg(F.count("*").alias("n"), F.count(F.when(F.col("odds") > 0, 1)).alias("k")).where(F.col("k") < F.least(F.lit(size), F.col("n")))
    if not short.isEmpty():
        raise ValueError("a task has fewer seed words with a positive weight than are drawn")
    drawn = requests.join(odds.where("odds > 0"), "dataset_idx")
    u = hash_uniform(seed, "dataset_idx", "prompt_idx", "place")
    # a task's words are one short group for each prompt
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.log(F.greatest(u, F.lit(1e-300))) / F.col("odds")).alias("key"), F.col("place"), F.col("word")))), 1, size)
    return drawn.groupBy("dataset_idx", "prompt_idx").agg(F.array_sort(F.array_distinct(F.transform(first, lambda x: x["word"]))).alias("seed_words"))


def expand_requests(tasks: DataFrame, count: str = "num_samples") -> DataFrame:
    """(dataset_idx, prompt_idx): one row for each requested sample."""
    return tasks.where(F.col(count) > 0).select("dataset_idx", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias("prompt_idx"))


def meta_prompts(tasks: DataFrame, requests: DataFrame, size: int = 2, seed: int = 0, suffix: str = "") -> DataFrame:
    """(dataset_idx, prompt_idx, request)."""
    words = draw_seed_words(tasks, requests, size, seed)
    return words.join(tasks.select("dataset_idx", "objective"), "dataset_idx").select("dataset_idx", "prompt_idx", prompt_request(F.col("objective"), F.col("seed_words"), suffix).alias("request"))


class ModelClient(Protocol):
    """What a model call needs; an instance is pickled to the workers and called from several threads of each."""

    def complete(self, request: str, schema: str, temperature: float, max_tokens: int) -> str:
        """The model's raw reply."""


class RateLimited(Exception):
    """Raised by a client for errors that are worth another try."""


#: The reply schemas: field names and kinds; no other field may stand in a reply.
REPLIES = {"prompt": {"prompt": str}, "response": {"response": str}, "pair": {"chosen": str, "rejected": str}, "score": {"score": int}}


def parse_reply(reply: str | None, schema: str) -> dict | None:
    """The fields of a valid reply, else None.

    Extra or missing fields and strings of another type are invalid.  An integer may also come as an integral number, a
    numeric string or a truth value.
    """
    try:
        data = json.loads(reply or "")
    except ValueError:
        return None
    fields = REPLIES[schema]
    if not isinstance(data, dict) or set(data) != set(fields):
        return None
    out = {}
    for name, kind in fields.items():
        v = data[name]
        if kind is str:
            if not isinstance(v, str):
                return None
        elif isinstance(v, bool):
            v = int(v)
        elif isinstance(v, float) and v.is_integer():
            v = int(v)
        elif isinstance(v, str):
            try:
                v = int(v.strip())
            except ValueError:
                return None
        elif not isinstance(v, int):
            return None
        out[name] = v
    return out


def tries(default: int = 3) -> int:
    """How often a request is sent at most (environment BACKOFF_RETRIES)."""
    return int(os.environ.get("BACKOFF_RETRIES", default))


def retried(call: Callable, most: int):
    """The result of ``call``, tried again after ``RateLimited`` with growing pauses, ``most`` times at most."""
    for attempt in range(most):
        try:
            return call()
        except RateLimited:
            if attempt + 1 == most:
                raise
            time.sleep(random.random() * 2**attempt * float(os.environ.get("BACKOFF_UNIT", "1")))
    raise ValueError("a request is sent at least once")


def _call(client: ModelClient, request: str, schema: str, temperature: float, max_tokens: int, most: int) -> str:
    return retried(lambda: client.complete(request, schema, temperature, max_tokens), most)


def _run(batches: Iterator[pa.RecordBatch], client: ModelClient, schema: str, temperature: float, max_tokens: int, most: int, threads: int) -> Iterator[pa.RecordBatch]:
    with ThreadPoolExecutor(threads) as pool:
        for batch in batches:
            replies = list(pool.map(lambda r: _call(client, r, schema, temperature, max_tokens, most), batch.column(1).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(replies, pa.string())], ["key", "query", "result"])


def in_flight(spark: SparkSession, max_concurrency: int) -> tuple[int, int]:
    """(partitions, threads in each) whose product is at most ``max_concurrency``, with no more partitions than cores."""
    if not 1 <= max_concurrency <= 256:
        raise ValueError("between 1 and 256 concurrent calls")
    parts = min(max_concurrency, spark.sparkContext.defaultParallelism)
    return parts, max_concurrency // parts


def call_model(
    requests: DataFrame, client: ModelClient, schema: str, cache: DataFrame | None = None, refresh: bool = False,
    temperature: float = 1.0, max_tokens: int = 1024, max_concurrency: int = 128, most: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replies to ``requests`` (request, nonce, and any keys), and the new cache rows.

    Equal requests are sent once.  Cached ones aren't sent at all unless ``refresh``; misses are written out before use, so a
    repeated task never sends them again.  At most ``max_concurrency`` requests are on their way at a time in the whole cluster, several
    from each partition.  Invalid replies are returned too but not cached.  Raises what the client raises after its last try.
    """
    parts, threads = in_flight(requests.sparkSession, max_concurrency)
    keyed = requests.withColumn("key", cache_key("request", "nonce"))
    asked = keyed.groupBy("key").agg(F.first("request").alias("query"), F.first("nonce").alias("nonce"))
    known = None if cache is None or refresh else cache.select("key", "result")
    misses = asked if known is None else asked.join(known, "key", "left_anti")
    limit = most or tries()
    called = arrow_map(
        misses.select("key", "query").repartition(parts, "key"),
        lambda it: _run(it, client, schema, temperature, max_tokens, limit, threads), "key string, query string, result string",
    )
    called = cut(called, "replies")
    fresh = called.join(asked.select("key", "nonce"), "key").select("key", "query", "result", "nonce")
    valid = valid_replies(fresh, "result", schema)
    results = called.select("key", "result")
    if known is not None:
        results = results.union(known.join(asked.select("key"), "key", "left_semi"))
    return keyed.join(results, "key", "left").drop("key"), valid


def _valid(batches: Iterator[pa.RecordBatch], column: int, schema: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [parse_reply(r, schema) is not None for r in batch.column(column).to_pylist()]
        yield batch.filter(pa.array(ok, pa.bool_()))


def valid_replies(df: DataFrame, reply: str, schema: str) -> DataFrame:
    """Only rows whose reply is valid."""
    at = df.columns.index(reply)
    return arrow_map(df, lambda it: _valid(it, at, schema), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def _parsed(batches: Iterator[pa.RecordBatch], column: int, schema: str, names: list[str], numeric: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_reply(r, schema) for r in batch.column(column).to_pylist()]
        keep = pa.array([r is not None for r in rows], pa.bool_())
        good = [r for r in rows if r is not None]
        own = batch.filter(keep)
        kind = pa.int64() if numeric else pa.string()
        yield pa.record_batch([*own.columns, *(pa.array([r[n] for r in good], kind) for n in names)], [*batch.schema.names, *names])


def parse_replies(df: DataFrame, reply: str, schema: str) -> DataFrame:
    """Add the fields of valid replies as columns and drop the other rows."""
    names = list(REPLIES[schema])
    numeric = REPLIES[schema][names[0]] is int
    at = df.columns.index(reply)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {'long' if numeric else 'string'}" for n in names)])
    return arrow_map(df, lambda it: _parsed(it, at, schema, names, numeric), kinds)


def cache_upsert(cache: DataFrame | None, new: DataFrame) -> DataFrame:
    """The cache with new rows; a new row replaces the one with its key."""
    new = new.dropDuplicates(["key"])
    return new if cache is None else cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def generate(
    tasks: DataFrame, client: ModelClient, cache: DataFrame | None = None, seed: int = 0, temperature: float = 1.0, include_axes: bool = False,
    dry_run: bool = False, seed_words: int = 2, max_tokens: tuple[int, int] = (1024, 2048), max_concurrency: int = 128,
) -> tuple[DataFrame, DataFrame]:
    """Generate a series from ``tasks`` (dataset_idx, domain, objective, preference, num_samples).

    Returns (samples, new cache rows).  A sample is numbered by its request, so the order never depends on when replies came;
    a request with an invalid reply gives no sample.  With ``include_axes`` two single responses are asked for, and a judge
    swaps them where it finds the second better aligned.  A dry run asks for one sample of the first task.
    """
    requests = expand_requests(tasks)
    if dry_run:
        requests = requests.orderBy("dataset_idx", "prompt_idx").limit(1)
    requests = cut(requests, "requests")
    run = dict(cache=cache, temperature=temperature, max_concurrency=max_concurrency)
    asked = meta_prompts(tasks, requests, seed_words, seed).withColumn("nonce", F.col("prompt_idx").cast("string"))
    replies, kept = call_model(asked, client, "prompt", max_tokens=max_tokens[0], **run)
    prompts = cut(parse_replies(replies.select("dataset_idx", "prompt_idx", "result"), "result", "prompt").drop("result"), "prompts")
    told = prompts.join(tasks.select("dataset_idx", "preference"), "dataset_idx").withColumn("nonce", F.lit(None).cast("string"))
    keys = ("dataset_idx", "prompt_idx")
    if not include_axes:
        replies, more = call_model(told.withColumn("request", response_request(F.col("prompt"), F.col("preference"))), client, "pair", max_tokens=max_tokens[1], **run)
        pairs = parse_replies(replies.select(*keys, "prompt", "result"), "result", "pair").drop("result")
        kept = kept.unionByName(more)
    else:
        sides = []
        for parity, name in enumerate(("chosen", "rejected")):
            one = told.withColumn("request", axes_request(F.col("prompt"), F.col("preference"), parity, seed, *keys))
            replies, more = call_model(one, client, "response", max_tokens=max_tokens[1], **run)
            sides.append(parse_replies(replies.select(*keys, "prompt", "result"), "result", "response").drop("result").withColumnRenamed("response", name))
            kept = kept.unionByName(more)
        pairs = cut(sides[0].join(sides[1].drop("prompt"), list(keys)), "pairs")
        judged = pairs.join(tasks.select("dataset_idx", "preference"), "dataset_idx").withColumn("nonce", F.lit(None).cast("string"))
        judged = judged.withColumn("request", judge_request(F.col("prompt"), F.col("chosen"), F.col("rejected"), F.col("preference")))
        replies, more = call_model(judged, client, "score", cache=cache, temperature=0.0, max_tokens=max_tokens[0], max_concurrency=max_concurrency)
        scores = parse_replies(replies.select(*keys, "result"), "result", "score").drop("result")
        from prefloom.operators.transforms import swap_by_verdict

        pairs = swap_by_verdict(pairs, scores, keys)
        kept = kept.unionByName(more)
    samples = pairs.select("dataset_idx", F.col("prompt_idx").cast("long").alias("sample_idx"), F.lit("train").alias("split"), "prompt", "chosen", "rejected")
    return samples, kept


class HashClient:
    """A deterministic stand-in for a model: replies are made from the request's hash.  Used by tests and dry runs."""

    def complete(self, request: str, schema: str, temperature: float, max_tokens: int) -> str:
        import hashlib

        h = hashlib.sha256(request.encode()).hexdigest()
        if schema == "score":
            return json.dumps({"score": int(h[:4], 16) % 2})
        return json.dumps({name: f"{name} {h[:12]}" for name in REPLIES[schema]})
