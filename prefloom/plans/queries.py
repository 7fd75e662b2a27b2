"""The registered queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import chat, preference, rollout, text
from prefloom.functions.rng import hash_uniform, uniform_sql
from prefloom.operators import generation as G
from prefloom.operators import metrics as M
from prefloom.operators import model_reports as R
from prefloom.operators import transforms as X
from prefloom.operators import validation as V
from prefloom.plans.views import ROLLOUT_SQL, SAMPLES_SQL, SCORES_SQL, rollouts, samples
from prefloom.session import cut, delete, shared_folder, table
from prefloom.sources import corpora as C
from prefloom.sources import json_io
from prefloom.sources.tasks import resolved_components

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TOK = lambda c: f"list_filter(regexp_split_to_array({c}, '{text.SPACE_RE2}'), lambda x: x <> '')"
_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS) + "]"
_KEPT = lambda c: f"list_filter({_TOK(c)}, lambda x: NOT list_contains({_STOP}, lower(x)))"
_WITH = f"WITH {SAMPLES_SQL} "
_LEN = lambda c: f"len({_TOK(c)})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _keys(df: DataFrame) -> DataFrame:
    return df.select("dataset_idx", "sample_idx", "split")


# --- reports ---------------------------------------------------------------------------------------------------------


def _count_sql(clean: Callable[[str], str]) -> str:
    c = {f: clean(f) for f in ("prompt", "chosen", "rejected")}
    render = clean("('Prompt: '||prompt||', Chosen: '||chosen||', Rejected: '||rejected)")
    return _WITH + (
        f", t AS (SELECT dataset_idx, {c['prompt']} AS p, {c['chosen']} AS c, {c['rejected']} AS r, {render} AS x, {_LEN('prompt')} AS lp, {_LEN('chosen')} AS lc, {_LEN('rejected')} AS lr FROM s)"
        " SELECT k.dataset_idx, count(x) AS sample, count(DISTINCT x) AS unique_samples, count(DISTINCT p) AS unique_prompts, count(DISTINCT c) AS unique_chosen,"
        " count(DISTINCT r) AS unique_rejected, coalesce(avg(lp),0)::double AS avg_prompt_length, coalesce(avg(lc),0)::double AS avg_chosen_length, coalesce(avg(lr),0)::double AS avg_rejected_length"
        " FROM tasks k LEFT JOIN t ON k.dataset_idx=t.dataset_idx GROUP BY k.dataset_idx"
    )


@query(_count_sql(lambda f: f))
def count_validation(spark, d):
    """A1: counts, distinct counts and mean words of each dataset."""
    return V.count_validation(table(spark, d, "samples"), table(spark, d, "tasks"), key="sample_id")


@query(_count_sql(lambda f: f"array_to_string({_KEPT(f)}, ' ')"))
def count_validation_stopwords(spark, d):
    """A1 with F1: stop words removed before distinct counts."""
    return V.count_validation(table(spark, d, "samples"), table(spark, d, "tasks"), True, "sample_id")


def _entropy_sql(words: Callable[[str], str]) -> str:
    each = " UNION ALL ".join(f"SELECT dataset_idx, '{f}' AS field, unnest({words(f)}) AS word FROM s" for f in ("prompt", "chosen", "rejected"))
    return _WITH + (
        f", w AS ({each}), c AS (SELECT dataset_idx, field, word, count(*) AS n FROM w GROUP BY ALL),"
        " h AS (SELECT dataset_idx, field, ln(sum(n)) - sum(n*ln(n))/sum(n) AS h FROM c GROUP BY ALL)"
        " SELECT k.dataset_idx, " + ", ".join(f"round(coalesce(max(CASE WHEN field='{f}' THEN h END),0),9) AS {f}_entropy" for f in ("prompt", "chosen", "rejected")) + " FROM tasks k LEFT JOIN h ON k.dataset_idx=h.dataset_idx GROUP BY k.dataset_idx"
    )


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@query(_entropy_sql(_TOK))
def entropy_validation(spark, d):
    """A5: word entropy of each dataset and column."""
    return _rounded(V.entropy_validation(samples(spark, d, "dataset_idx", "prompt", "chosen", "rejected"), table(spark, d, "tasks")))


@query(_entropy_sql(_KEPT))
def entropy_validation_stopwords(spark, d):
    """A5 with F1."""
    return _rounded(V.entropy_validation(samples(spark, d, "dataset_idx", "prompt", "chosen", "rejected"), table(spark, d, "tasks"), True))


@query(_WITH + ", w AS (" + " UNION ALL ".join(f"SELECT dataset_idx, '{f}' AS field, unnest({_TOK(f)}) AS word FROM s" for f in ("prompt", "chosen", "rejected")) + ") SELECT dataset_idx, field, word, count(*) AS n FROM w GROUP BY ALL")
def word_frequencies(spark, d):
    """A4: word counts of each dataset and column."""
    return V.word_frequencies(samples(spark, d, "dataset_idx", "prompt", "chosen", "rejected"))


_TOTALS = "count(*) AS num_samples, count(*) FILTER (split='train') AS num_train_samples, count(*) FILTER (split='test') AS num_test_samples, (count(*) FILTER (split='train'))/count(*)::double AS train_frac, (count(*) FILTER (split='test'))/count(*)::double AS test_frac"


@query(_WITH + f"SELECT dataset_idx, {_TOTALS} FROM s GROUP BY dataset_idx")
def dataset_totals(spark, d):
    """A11 by dataset."""
    return V.totals(samples(spark, d, "dataset_idx", "split"))


@query(_WITH + f"SELECT count(DISTINCT dataset_idx) AS num_datasets, {_TOTALS} FROM s")
def series_totals(spark, d):
    """A11 for the series."""
    return V.totals(samples(spark, d, "dataset_idx", "split"), False)


@query(_WITH + ", m AS (SELECT dataset_idx, count(*) AS produced FROM s GROUP BY 1) SELECT t.dataset_idx, 50::bigint AS requested, coalesce(produced,0) AS produced, 50-coalesce(produced,0) AS missing FROM tasks t LEFT JOIN m USING (dataset_idx)")
def requested_shortfall(spark, d):
    """Samples requested (50 for each task) against those there."""
    return V.shortfall(table(spark, d, "tasks").select("dataset_idx", F.lit(50).alias("num_samples")), samples(spark, d, "dataset_idx"))


_DIV = (
    "WITH x AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding,1) AS k FROM embeddings),"
    " n AS (SELECT vec_id, greatest(sqrt(sum(x*x)),1e-10) AS n FROM x GROUP BY 1), u AS (SELECT vec_id, label, k, x/n AS u FROM x JOIN n USING (vec_id)),"
    " t AS (SELECT label, k, sum(u) AS t FROM u GROUP BY ALL), c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY 1),"
    " v AS (SELECT vec_id, label, 1-sum(u*t)/any_value(c) AS diversity FROM u JOIN t USING (label,k) JOIN c USING (label) GROUP BY ALL)"
)


@query(_DIV + " SELECT label, round(avg(diversity),9) AS mean, round(quantile_cont(diversity,0.5),9) AS median, round(min(diversity),9) AS min, round(max(diversity),9) AS max FROM v GROUP BY label")
def embedding_diversity(spark, d):
    """Diversity statistics of each group."""
    return _rounded(V.diversity_report(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", ["label"]))


@query(_DIV + " SELECT vec_id, round(diversity,9) AS diversity FROM v")
def embedding_diversity_rows(spark, d):
    """Each vector's mean dissimilarity to its group."""
    return _rounded(V.diversity(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", ["label"]).select("vec_id", "diversity"))


_JUDGE = ", ".join(
    f"round({fn},9) AS {m}_{name}"
    for name, f in (("mean", "avg({})"), ("median", "quantile_cont({},0.5)"), ("min", "min({})::double"), ("max", "max({})::double"))
    for m in V.METRICS
    for fn in (f.format(f"CASE WHEN metric='{m}' THEN score END"),)
)


@query(f"WITH {SAMPLES_SQL}, {SCORES_SQL}, b AS (SELECT dataset_idx, metric, score FROM s JOIN j USING (sample_id)) SELECT k.dataset_idx, {_JUDGE} FROM tasks k LEFT JOIN b USING (dataset_idx) GROUP BY k.dataset_idx")
def judge_report(spark, d):
    """Judge statistics of each dataset, scores clamped to 0..10."""
    report = V.judge_report(samples(spark, d, "sample_id", "dataset_idx"), V.latest_scores(table(spark, d, "judge_scores")), table(spark, d, "tasks"))
    return _rounded(report.select("dataset_idx", *(F.col(c).cast("double").alias(c) for c in report.columns if c != "dataset_idx")))


@query(
    f"WITH {SAMPLES_SQL}, {SCORES_SQL}, m AS (SELECT unnest(['alignment','coherence_chosen','coherence_rejected']) AS metric), z AS (SELECT dataset_idx, count(*) AS samples FROM s GROUP BY 1),"
    " h AS (SELECT dataset_idx, metric, count(score) AS scored FROM s JOIN j USING (sample_id) GROUP BY ALL)"
    " SELECT dataset_idx, metric, samples, coalesce(scored,0) AS scored, coalesce(scored,0)/samples::double AS coverage FROM z CROSS JOIN m LEFT JOIN h USING (dataset_idx, metric)"
)
def judge_coverage(spark, d):
    """A10: share of samples with a score."""
    return V.judge_coverage(samples(spark, d, "sample_id", "dataset_idx"), V.latest_scores(table(spark, d, "judge_scores")))


@query(_WITH + "SELECT sample_id, unnest(['prompt','chosen','rejected']) AS text_type, md5(unnest([prompt,chosen,rejected])) AS text_md5 FROM s")
def unpivot_texts(spark, d):
    """The texts of each sample in rows (digests stand for long texts)."""
    rows = V.unpivot_texts(samples(spark, d, "sample_id", "prompt", "chosen", "rejected"), ["sample_id"])
    return rows.select("sample_id", "text_type", F.md5("text").alias("text_md5"))


@query(_WITH + "SELECT sample_id, sha256('Prompt: '||prompt||', Chosen: '||chosen||', Rejected: '||rejected) AS sample_digest FROM s")
def render_samples(spark, d):
    """One string for each sample."""
    return samples(spark, d, "sample_id", "prompt", "chosen", "rejected").select("sample_id", F.sha2(text.render_sample(), 256).alias("sample_digest"))


_COHERENCE = {f: f"{_q(G.COHERENCE_TEXT[0])}||{f}||{_q(G.COHERENCE_TEXT[1])}" for f in ("chosen", "rejected")}
_ASKED = ", ".join(f"('0x'||substr(sha256({r}),1,4))::int % 2 AS {m}" for m, r in zip(V.METRICS, (f"{_q(G.JUDGE_TEXT[0])}||coalesce(preference,'')||{_q(G.JUDGE_TEXT[1])}||prompt||{_q(G.JUDGE_TEXT[2])}||chosen||{_q(G.JUDGE_TEXT[3])}||rejected||{_q(G.JUDGE_TEXT[4])}", *_COHERENCE.values()), strict=True))
_STATISTICS = ", ".join(f"round({f.format(m)},9) AS {m}_{n}" for m in V.METRICS for n, f in (("mean", "avg({})"), ("median", "quantile_cont({},0.5)"), ("min", "min({})::double"), ("max", "max({})::double")))


@query(_WITH + f", j AS (SELECT dataset_idx, {_ASKED} FROM s JOIN tasks USING (dataset_idx)) SELECT k.dataset_idx, {_STATISTICS} FROM tasks k LEFT JOIN j USING (dataset_idx) GROUP BY k.dataset_idx")
def judge_validation(spark, d):
    """Every sample judged by a (stand-in) model, statistics of each dataset."""
    report, _ = R.judge_validation(samples(spark, d, "sample_id", "dataset_idx", "prompt", "chosen", "rejected"), table(spark, d, "tasks"), G.HashClient(), max_concurrency=16)
    return _rounded(report.select("dataset_idx", *(F.col(c).cast("double").alias(c) for c in report.columns if c != "dataset_idx")))


_VECTOR = "[" + ",".join(f"('0x'||substr(md5(text),{4 * k + 1},4))::int/65535.0::double-0.5" for k in range(8)) + "]"
_WIDE = ", ".join(f"round(max(CASE WHEN text_type='{f}' THEN {n} END),6) AS {f}_{n}" for f in ("prompt", "chosen", "rejected") for n in R.STATS)


@query(
    _WITH + f", x AS (SELECT row_number() OVER () AS i, dataset_idx, text_type, {_VECTOR} AS e FROM (SELECT dataset_idx, unnest(['prompt','chosen','rejected']) AS text_type, unnest([prompt,chosen,rejected]) AS text FROM s)),"
    " y AS (SELECT i, dataset_idx, text_type, unnest(e) AS x, generate_subscripts(e,1) AS k FROM x), n AS (SELECT i, greatest(sqrt(sum(x*x)),1e-10) AS n FROM y GROUP BY 1), u AS (SELECT y.*, x/n AS u FROM y JOIN n USING (i)),"
    " t AS (SELECT dataset_idx, text_type, k, sum(u) AS t FROM u GROUP BY ALL), c AS (SELECT dataset_idx, text_type, count(*) AS c FROM x GROUP BY ALL),"
    " v AS (SELECT i, dataset_idx, text_type, 1-sum(u*t)/any_value(c) AS d FROM u JOIN t USING (dataset_idx,text_type,k) JOIN c USING (dataset_idx,text_type) GROUP BY ALL),"
    " z AS (SELECT dataset_idx, text_type, avg(d) AS mean, quantile_cont(d,0.5) AS median, min(d) AS min, max(d) AS max FROM v GROUP BY ALL)"
    f" SELECT k.dataset_idx, {_WIDE} FROM tasks k LEFT JOIN z USING (dataset_idx) GROUP BY k.dataset_idx"
)
def embedding_validation(spark, d):
    """Every text embedded by a (stand-in) model, diversity of each dataset and column."""
    report = R.embedding_validation(samples(spark, d, "sample_id", "dataset_idx", "prompt", "chosen", "rejected"), table(spark, d, "tasks"), R.HashEmbedder(), max_concurrency=16)
    return _rounded(report, 6)


# --- transforms ------------------------------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY dataset_idx ORDER BY sample_idx)"


@query(_WITH + f", r AS (SELECT dataset_idx, sample_idx, {_RANK} AS k, count(*) OVER (PARTITION BY dataset_idx) AS n FROM s) SELECT dataset_idx, sample_idx, CASE WHEN k <= trunc((1-0.3::double)*n) THEN 'train' ELSE 'test' END AS split FROM r")
def split_positional(spark, d):
    """Split by position, a test ratio of 0.3."""
    return _keys(X.split(samples(spark, d, "dataset_idx", "sample_idx"), 0.3))


def _swap(p: float) -> None:
    cond = f"{uniform_sql(7, 'dataset_idx', 'sample_idx')} < {p}::double"
    sql = _WITH + f"SELECT sample_id, md5(CASE WHEN {cond} THEN rejected ELSE chosen END) AS chosen_md5, md5(CASE WHEN {cond} THEN chosen ELSE rejected END) AS rejected_md5 FROM s"

    def run(spark, d):
        s = samples(spark, d, "sample_id", "dataset_idx", "sample_idx", "chosen", "rejected")
        return X.preference_swap(s, p, 7).select("sample_id", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))

    run.__name__ = f"preference_swap_p{int(p * 100)}"
    run.__doc__ = "P4, M3: swap chosen and rejected with a probability."
    query(sql)(run)


for _p in (0.0, 0.5, 1.0):
    _swap(_p)


@query(
    f"WITH {SAMPLES_SQL}, {SCORES_SQL}, a AS (SELECT sample_id, score FROM j WHERE metric='alignment' AND score IN (0,1))"
    " SELECT sample_id, coalesce(score=0,false) AS swapped, md5(CASE WHEN score=0 THEN rejected ELSE chosen END) AS chosen_md5 FROM s LEFT JOIN a USING (sample_id)"
)
def verdict_swap(spark, d):
    """Swap where the judge preferred the rejected text."""
    scores = V.latest_scores(table(spark, d, "judge_scores")).where("metric = 'alignment'").select("sample_id", "score")
    s = samples(spark, d, "sample_id", "chosen", "rejected").withColumn("before", F.col("chosen"))
    zero = scores.where("score = 0").select("sample_id", F.lit(True).alias("zero"))
    out = X.swap_by_verdict(s, scores, ("sample_id",)).join(zero, "sample_id", "left")
    return out.select("sample_id", F.coalesce("zero", F.lit(False)).alias("swapped"), F.md5("chosen").alias("chosen_md5"))


def _sample_sql(k: str) -> str:
    u = uniform_sql(3, "dataset_idx", "sample_idx")
    return _WITH + f", r AS (SELECT *, row_number() OVER (PARTITION BY dataset_idx, split ORDER BY {u}, sample_idx) AS sample_order, count(*) OVER (PARTITION BY dataset_idx, split) AS n FROM s) SELECT dataset_idx, sample_idx, split, sample_order FROM r WHERE sample_order <= least(n, {k})"


@query(_sample_sql("trunc((CASE WHEN split='train' THEN 0.25 ELSE 0.5 END)::double*n)"))
def stratified_sample(spark, d):
    """M1: a quarter of train, half of test, of each dataset."""
    return X.stratified_sample(samples(spark, d, "dataset_idx", "sample_idx", "split"), 0.25, 0.5, seed=3).select("dataset_idx", "sample_idx", "split", "sample_order")


@query(_sample_sql("CASE WHEN split='train' THEN 10 ELSE trunc(0.5::double*n) END"))
def stratified_sample_amount(spark, d):
    """An amount for train, clamped to its size, a ratio for test."""
    return X.stratified_sample(samples(spark, d, "dataset_idx", "sample_idx", "split"), 0.25, 0.5, 10, seed=3).select("dataset_idx", "sample_idx", "split", "sample_order")


@query(_WITH + ", m AS (SELECT max(dataset_idx)+1 AS k FROM s) SELECT dataset_idx, sample_idx, split FROM s UNION ALL SELECT (dataset_idx+k)::int, sample_idx, split FROM s, m")
def merge_series(spark, d):
    """A series followed by another, indexes shifted."""
    s = _keys(samples(spark, d, "dataset_idx", "sample_idx", "split"))
    return X.merge(s, s)


_GLOBAL = _WITH + ", g AS (SELECT dataset_idx, sample_idx, row_number() OVER (ORDER BY dataset_idx, sample_idx) - 1 AS global_idx, count(*) OVER () AS n FROM s) SELECT dataset_idx, sample_idx, global_idx FROM g WHERE "


@query(_GLOBAL + "global_idx >= 20 AND global_idx < 170")
def slice_global(spark, d):
    """Rows 20 to 170 of the whole series."""
    return X.take_slice(samples(spark, d, "dataset_idx", "sample_idx"), 20, 170)


@query(_GLOBAL + "global_idx >= n-90 AND global_idx < n-5")
def slice_negative(spark, d):
    """Bounds counted from the end."""
    return X.take_slice(samples(spark, d, "dataset_idx", "sample_idx"), -90, -5)


@query(_GLOBAL + "global_idx = n-1")
def item_last(spark, d):
    """The last row by index -1."""
    return X.take_at(samples(spark, d, "dataset_idx", "sample_idx"), -1)


@query(_WITH + f", r AS (SELECT dataset_idx, sample_idx, {_RANK} AS k FROM s) SELECT dataset_idx, sample_idx FROM r WHERE k <= 40")
def range_select(spark, d):
    """The first 40 rows of each dataset."""
    return X.take_first(samples(spark, d, "dataset_idx", "sample_idx"), 40)


@query(_WITH + f"SELECT sample_id FROM s WHERE chosen <> rejected AND {_LEN('chosen')} >= 5 AND {_LEN('rejected')} >= 5")
def quality_filter(spark, d):
    """equal or short answers dropped."""
    return X.quality_filter(samples(spark, d, "sample_id", "chosen", "rejected")).select("sample_id")


@query(_WITH + "SELECT sample_id, CASE WHEN contains(lower(prompt),'r/relationships') THEN 'relationships' ELSE 'others' END AS category FROM s")
def prompt_category(spark, d):
    """Category by prompt."""
    return samples(spark, d, "sample_id", "prompt").select("sample_id", text.category().alias("category"))


@query(_WITH + "SELECT sample_id FROM s WHERE NOT contains(lower(prompt),'r/relationships')")
def category_filter(spark, d):
    """F3."""
    return X.category_filter(samples(spark, d, "sample_id", "prompt"), "others").select("sample_id")


@query(_WITH + f"SELECT dataset_idx, sample_idx, ({_RANK}-1)//16 AS batch FROM s")
def batches(spark, d):
    """Batches of 16 by order."""
    return X.in_batches(samples(spark, d, "dataset_idx", "sample_idx"), 16)


@query(
    _WITH + f", r AS (SELECT dataset_idx, sample_idx, row_number() OVER (PARTITION BY dataset_idx ORDER BY {uniform_sql(5, 'dataset_idx', 'sample_idx')}, sample_idx)-1 AS place, count(*) OVER (PARTITION BY dataset_idx) AS n FROM s)"
    " SELECT dataset_idx, sample_idx, place, place//8 AS batch FROM r WHERE place//8 < n//8"
)
def minibatches(spark, d):
    """M7: a permutation in full minibatches of 8."""
    return X.minibatches(samples(spark, d, "dataset_idx", "sample_idx"), 8, 5)


@query(_WITH + f"SELECT dataset_idx, sample_idx FROM s WHERE dataset_idx=7 AND split='train' ORDER BY {uniform_sql(2, 'dataset_idx', 'sample_idx')}, sample_idx LIMIT 1 OFFSET 3")
def preview_page(spark, d):
    """L4, M8: the fourth sample shown of one shuffled split."""
    return X.preview(samples(spark, d, "dataset_idx", "sample_idx", "split"), 7, "train", 3, True, 2).select("dataset_idx", "sample_idx")


def _replay_sql(steps: int = 40, capacity: int = 60) -> str:
    """The fold, one step after another: a table of each step's buffer."""
    u = lambda e, d, x: f"('0x'||substr(md5({e}||':'||{d}::varchar||':'||{x}::varchar),1,13))::bigint::double"
    parts = [
        f"w AS MATERIALIZED (SELECT dataset_idx, sample_idx FROM s WHERE split='train')",
        "t AS MATERIALIZED (SELECT dataset_idx, row_number() OVER (ORDER BY dataset_idx) AS step FROM (SELECT DISTINCT dataset_idx FROM w))",
        f"k AS (SELECT dataset_idx, sample_idx, row_number() OVER (PARTITION BY dataset_idx ORDER BY {u(_q('4-add'), 'dataset_idx', 'sample_idx')}, sample_idx) AS k, count(*) OVER (PARTITION BY dataset_idx) AS n FROM w)",
        "a AS MATERIALIZED (SELECT dataset_idx, sample_idx, step FROM k JOIN t USING (dataset_idx) WHERE k <= least(n, greatest(1, trunc(0.1::double*n))))",
    ]
    for i in range(1, steps + 1):
        before = f"SELECT dataset_idx, sample_idx FROM b{i - 1} UNION ALL " if i > 1 else ""
        order = u(f"(SELECT '4-keep-'||dataset_idx::varchar FROM t WHERE step={i})", "z.dataset_idx", "z.sample_idx")
        parts.append(f"b{i} AS MATERIALIZED (SELECT dataset_idx, sample_idx FROM ({before}SELECT dataset_idx, sample_idx FROM a WHERE step={i}) z ORDER BY {order}, dataset_idx, sample_idx LIMIT {capacity})")
    every = " UNION ALL ".join(f"SELECT b.dataset_idx, b.sample_idx, t.dataset_idx AS after FROM b{i} b, t WHERE step={i}" for i in range(1, steps + 1))
    return _WITH + ", " + ", ".join(parts) + " " + every


@query(_replay_sql())
def replay_buffer(spark, d):
    """M5: the memory after each dataset (a tenth of each joins, at most 60 stay)."""
    s = samples(spark, d, "dataset_idx", "sample_idx", "split").where("split = 'train'")
    return X.replay_buffer(s, ratio=0.1, capacity=60, seed=4).select("dataset_idx", "sample_idx", "after")


@query(_WITH + f", r AS (SELECT dataset_idx, sample_idx, row_number() OVER (PARTITION BY dataset_idx ORDER BY {uniform_sql(6, 'dataset_idx', 'sample_idx')}, sample_idx) AS k FROM s) SELECT dataset_idx, sample_idx FROM r WHERE k <= 500")
def importance_subset(spark, d):
    """M6: at most 500 uniformly drawn samples of each dataset."""
    from prefloom.operators.ordered import rank_within

    ranked = rank_within(samples(spark, d, "dataset_idx", "sample_idx"), ["dataset_idx"], hash_uniform(6, "dataset_idx", "sample_idx"), ["sample_idx"], "k")
    return ranked.where("k <= 500").select("dataset_idx", "sample_idx")


@query(
    _WITH + ", r AS (SELECT dataset_idx, split, row_number() OVER (PARTITION BY dataset_idx ORDER BY split DESC, sample_idx) AS k, count(*) OVER (PARTITION BY dataset_idx) AS n, count(*) FILTER (split='train') OVER (PARTITION BY dataset_idx) AS t FROM s)"
    " SELECT dataset_idx, k-1 AS sample_idx, CASE WHEN k <= trunc(t/n::double*n) THEN 'train' ELSE 'test' END AS split FROM r"
)
def resplit_compatible(spark, d):
    """The boundary that a reader of a file with both lists gets."""
    return _keys(X.resplit_compatible(samples(spark, d, "dataset_idx", "sample_idx", "split")))


# --- prompts, vocabulary, cache --------------------------------------------------------------------------------------

_ODDS = (
    "c AS (SELECT dataset_idx, unnest(map_keys(domain)) AS name, unnest(map_values(domain)) AS v FROM tasks),"
    " cc AS (SELECT dataset_idx, row_number() OVER (PARTITION BY dataset_idx ORDER BY name)-1 AS c, coalesce(v.weight,1.0::double) AS weight, v.seed_words AS words FROM c),"
    " o AS (SELECT dataset_idx, c*100000 + unnest(generate_series(0,len(words)-1)) AS place, unnest(words) AS word, weight/sum(weight) OVER (PARTITION BY dataset_idx)/1.0 AS share, len(words) AS n FROM cc)"
)


def _requests(spark, d, n: int = 5) -> DataFrame:
    return G.expand_requests(table(spark, d, "tasks").select("dataset_idx", F.lit(n).alias("num_samples")))


@query(
    "WITH c AS (SELECT dataset_idx, unnest(map_keys(domain)) AS name, unnest(map_values(domain)) AS v FROM tasks),"
    " t AS (SELECT dataset_idx, sum(coalesce(v.weight,1)) AS total FROM c GROUP BY 1),"
    " cc AS (SELECT c.dataset_idx, row_number() OVER (PARTITION BY c.dataset_idx ORDER BY name)-1 AS c, coalesce(v.weight,1.0::double)/total/len(v.seed_words) AS odds, v.seed_words AS words FROM c JOIN t USING (dataset_idx))"
    " SELECT dataset_idx, (c*100000 + unnest(generate_series(0,len(words)-1)))::int AS place, unnest(words) AS word, round(odds,9) AS odds FROM cc"
)
def seed_word_odds(spark, d):
    """M2: the odds of every seed word."""
    return _rounded(G.seed_word_odds(table(spark, d, "tasks")))


def _draw_sql(n: int, seed: int) -> str:
    """Two seed words for each of ``n`` prompts of every task, as table ``words``."""
    return (
        "WITH c AS (SELECT dataset_idx, unnest(map_keys(domain)) AS name, unnest(map_values(domain)) AS v FROM tasks),"
        " t AS (SELECT dataset_idx, sum(coalesce(v.weight,1)) AS total FROM c GROUP BY 1),"
        " cc AS (SELECT c.dataset_idx, row_number() OVER (PARTITION BY c.dataset_idx ORDER BY name)-1 AS c, coalesce(v.weight,1.0::double)/total/len(v.seed_words) AS odds, v.seed_words AS words FROM c JOIN t USING (dataset_idx)),"
        " o AS (SELECT dataset_idx, (c*100000 + unnest(generate_series(0,len(words)-1)))::int AS place, unnest(words) AS word, odds FROM cc),"
        f" q AS (SELECT dataset_idx, unnest(generate_series(0,{n - 1}))::int AS prompt_idx FROM tasks),"
        f" k AS (SELECT *, -ln(greatest({uniform_sql(seed, 'dataset_idx', 'prompt_idx', 'place')},1e-300))/odds AS key FROM q JOIN o USING (dataset_idx) WHERE odds > 0),"
        " p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY dataset_idx, prompt_idx ORDER BY key, place) <= 2),"
        " words AS (SELECT dataset_idx, prompt_idx, list_sort(list_distinct(list(word))) AS seed_words FROM p GROUP BY ALL)"
    )


_DRAW = _draw_sql(5, 11)
_META = f"{_q(G.PROMPT_TEXT[0] + G.PROMPT_TEXT[1])}||coalesce(objective,'')||{_q(G.PROMPT_TEXT[2])}||array_to_string(seed_words, ',')||{_q(G.PROMPT_TEXT[3])}"
_PAIR = f"{_q(G.RESPONSE_TEXT[0])}||prompt||{_q(G.RESPONSE_TEXT[1])}||coalesce(preference,'')||{_q(G.RESPONSE_TEXT[2])}"
_JUDGED = f"{_q(G.JUDGE_TEXT[0])}||coalesce(preference,'')||{_q(G.JUDGE_TEXT[1])}||prompt||{_q(G.JUDGE_TEXT[2])}||chosen||{_q(G.JUDGE_TEXT[3])}||rejected||{_q(G.JUDGE_TEXT[4])}"
#: What the hash stand-in replies.
_reply = lambda name, request: f"'{name} '||substr(sha256({request}),1,12)"
_verdict = lambda request: f"('0x'||substr(sha256({request}),1,4))::int % 2"


def _axes_drawn(parity: int, seed: int, *keys: str) -> str:
    """The axes of one response in their drawn order, as a list."""
    each = ",".join(f"{{'u':{uniform_sql(f'{seed}-axis-{parity}-{i}', *keys)},'low':{_q(low)},'high':{_q(high)}}}" for i, (low, high) in enumerate(G.AXES))
    return f"list_sort([{each}])"


def _axes_sql(axes: str, parity: int, seed: int, *keys: str) -> str:
    """The request of one response, from prompt, preference and the list ``axes``."""
    pad = G.AXES_PAD
    word = "must follow" if parity == 0 else "must not respect"
    wish = f"CASE WHEN {uniform_sql(f'{seed}-include-{parity}', *keys)} < {G.INCLUDE_PREFERENCE}::double THEN {_q(f'Your response {word} this preference overall: PREFERENCE: ')}||coalesce(preference,'')||chr(10) ELSE '' END"
    lines = "||".join(
        f"'On a scale of 1 to 2 where 1 is '||{axes}[{i + 1}].low||' and 2 is '||{axes}[{i + 1}].high||', your response should be: '||(floor({uniform_sql(f'{seed}-score-{i}', *keys)}*5)+1)::int::varchar||chr(10)"
        for i in range(G.AXES_DRAWN)
    )
    end = "Please ensure your responses aligns with the provided scores.'\n" + pad + 'You don\'t need to start your response by saying "here is the response" nor to give any meta-explanation. Just provide the response.\n'
    return f"{_q(pad + 'Generate a response to the following prompt: ' + chr(39))}||prompt||{_q(chr(39) + '.' + chr(10) + pad)}||{wish}||{_q(' and' + chr(10) + pad)}||{lines}||{_q(end)}"


@query(_DRAW + " SELECT dataset_idx, prompt_idx, array_to_string(seed_words, ',') AS seed_words FROM words")
def seed_word_draws(spark, d):
    """M2: two seed words for each of five prompts of every task."""
    return G.draw_seed_words(table(spark, d, "tasks"), _requests(spark, d), 2, 11).select("dataset_idx", "prompt_idx", F.array_join("seed_words", ",").alias("seed_words"))


@query(
    _DRAW + f" SELECT dataset_idx, prompt_idx, {_q(G.PROMPT_TEXT[0] + G.PROMPT_TEXT[1])}||objective||{_q(G.PROMPT_TEXT[2])}||array_to_string(seed_words, ',')||{_q(G.PROMPT_TEXT[3])} AS request FROM words JOIN tasks USING (dataset_idx)"
)
def meta_prompts(spark, d):
    """The requests that make a model write prompts."""
    return G.meta_prompts(table(spark, d, "tasks"), _requests(spark, d), 2, 11)


@query(_WITH + f"SELECT sample_id, sha256({_q(G.RESPONSE_TEXT[0])}||prompt||{_q(G.RESPONSE_TEXT[1])}||preference||{_q(G.RESPONSE_TEXT[2])}) AS request_digest FROM s JOIN tasks USING (dataset_idx)")
def response_prompts(spark, d):
    """The requests for response pairs."""
    joined = samples(spark, d, "sample_id", "dataset_idx", "prompt").join(table(spark, d, "tasks").select("dataset_idx", "preference"), "dataset_idx")
    return joined.select("sample_id", F.sha2(G.response_request(F.col("prompt"), F.col("preference")), 256).alias("request_digest"))


@query(
    _WITH + f", x AS (SELECT sample_id, dataset_idx, sample_idx, prompt, preference, {_axes_drawn(0, 9, 'dataset_idx', 'sample_idx')} AS a0, {_axes_drawn(1, 9, 'dataset_idx', 'sample_idx')} AS a1 FROM s JOIN tasks USING (dataset_idx))"
    f" SELECT sample_id, {_axes_sql('a0', 0, 9, 'dataset_idx', 'sample_idx')} AS request_0, {_axes_sql('a1', 1, 9, 'dataset_idx', 'sample_idx')} AS request_1 FROM x"
)
def axes_prompts(spark, d):
    """The two requests of contrasting responses (drawn axes and scores)."""
    t = table(spark, d, "tasks").select("dataset_idx", "preference")
    joined = samples(spark, d, "sample_id", "dataset_idx", "sample_idx", "prompt").join(t, "dataset_idx")
    both = [G.axes_request(F.col("prompt"), F.col("preference"), i, 9, "dataset_idx", "sample_idx").alias(f"request_{i}") for i in (0, 1)]
    return joined.select("sample_id", *both)


@query(
    _WITH + "SELECT sample_id, unnest(['alignment','coherence_chosen','coherence_rejected']) AS metric, sha256(unnest(["
    + f"{_q(G.JUDGE_TEXT[0])}||preference||{_q(G.JUDGE_TEXT[1])}||prompt||{_q(G.JUDGE_TEXT[2])}||chosen||{_q(G.JUDGE_TEXT[3])}||rejected||{_q(G.JUDGE_TEXT[4])},"
    + ",".join(f"{_q(G.COHERENCE_TEXT[0])}||{f}||{_q(G.COHERENCE_TEXT[1])}" for f in ("chosen", "rejected")) + "])) AS request_digest FROM s JOIN tasks USING (dataset_idx)"
)
def judge_prompts(spark, d):
    """Three judge requests for each sample."""
    rows = G.judge_requests(samples(spark, d, "sample_id", "dataset_idx", "prompt", "chosen", "rejected"), table(spark, d, "tasks"), ["sample_id"])
    return rows.select("sample_id", "metric", F.sha2("request", 256).alias("request_digest"))


@query(
    "WITH c AS (SELECT dataset_idx, unnest(map_values(domain)) AS v FROM tasks), k AS (SELECT alias, count(*) AS known FROM seed_words GROUP BY 1)"
    " SELECT dataset_idx, v.name AS name, len(v.seed_words)::int AS words, known FROM c LEFT JOIN k ON v.name=k.alias"
)
def vocabulary_lookup(spark, d):
    """Components and the vocabularies they name."""
    return resolved_components(table(spark, d, "tasks"), table(spark, d, "seed_words"))


@query(_WITH + "SELECT sample_id, sha256(prompt||chr(10)||sample_idx::varchar) AS with_nonce, sha256(prompt) AS without_nonce FROM s")
def cache_keys(spark, d):
    """Cache keys of prompts with and without a nonce."""
    s = samples(spark, d, "sample_id", "sample_idx", "prompt")
    return s.select("sample_id", text.cache_key("prompt", F.col("sample_idx").cast("string")).alias("with_nonce"), text.cache_key("prompt").alias("without_nonce"))


@query(_WITH + ", k AS (SELECT DISTINCT sha256(prompt) AS key FROM s WHERE split='train'), a AS (SELECT DISTINCT sha256(prompt) AS key FROM s WHERE split='test') SELECT key, key IN (SELECT key FROM k) AS hit FROM a")
def cache_probe(spark, d):
    """Prompts of the test split against a cache of the train split's."""
    s = samples(spark, d, "split", "prompt").select("split", text.cache_key("prompt").alias("key"))
    cache = s.where("split = 'train'").select("key").distinct()
    asked = s.where("split = 'test'").select("key").distinct()
    return asked.join(cache.withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    _WITH + ", a AS (SELECT sha256(prompt) AS key, max(sample_id) AS nonce, 1 AS o FROM s WHERE split='train' GROUP BY 1), b AS (SELECT sha256(prompt) AS key, max(sample_id) AS nonce, 2 AS o FROM s WHERE split='test' GROUP BY 1),"
    " u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT key, nonce FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY o DESC)=1"
)
def cache_upsert(spark, d):
    """K6: new replies replace those with their key."""
    s = samples(spark, d, "sample_id", "split", "prompt").withColumn("key", text.cache_key("prompt"))
    old, new = (s.where(F.col("split") == x).groupBy("key").agg(F.max("sample_id").alias("nonce")) for x in ("train", "test"))
    return G.cache_upsert(old, new)


_SERIES = f", g AS (SELECT dataset_idx, prompt_idx, {_reply('prompt', _META)} AS prompt, preference FROM words JOIN tasks USING (dataset_idx))"
_SAMPLE = "SELECT dataset_idx, prompt_idx::bigint AS sample_idx, 'train' AS split, prompt"


@query(_draw_sql(3, 1) + _SERIES + f" {_SAMPLE}, {_reply('chosen', _PAIR)} AS chosen, {_reply('rejected', _PAIR)} AS rejected FROM g")
def generated_series(spark, d):
    """A series generated with a deterministic client, three samples for each task."""
    tasks = table(spark, d, "tasks").withColumn("num_samples", F.lit(3))
    return G.generate(tasks, G.HashClient(), seed=1, max_concurrency=8)[0]


_BOTH = ", ".join(f"{_axes_drawn(i, 1, 'dataset_idx', 'prompt_idx')} AS a{i}" for i in (0, 1))
_SIDES = ", ".join(f"{_reply('response', _axes_sql(f'a{i}', i, 1, 'dataset_idx', 'prompt_idx'))} AS {name}" for i, name in enumerate(("chosen", "rejected")))


@query(
    _draw_sql(2, 1) + _SERIES + f", h AS (SELECT *, {_BOTH} FROM g), r AS (SELECT dataset_idx, prompt_idx, prompt, preference, {_SIDES} FROM h), j AS (SELECT *, {_verdict(_JUDGED)} AS v FROM r)"
    f" {_SAMPLE}, CASE WHEN v=0 THEN rejected ELSE chosen END AS chosen, CASE WHEN v=0 THEN chosen ELSE rejected END AS rejected FROM j"
)
def generated_axes(spark, d):
    """The same with contrasting responses and a judge."""
    tasks = table(spark, d, "tasks").withColumn("num_samples", F.lit(2))
    return G.generate(tasks, G.HashClient(), seed=1, include_axes=True, max_concurrency=8)[0]


@query("SELECT score_id, score::bigint AS parsed FROM judge_scores WHERE score IS NOT NULL AND score_id % 3 <> 0 GROUP BY ALL UNION ALL SELECT score_id, NULL FROM judge_scores WHERE false")
def valid_replies(spark, d):
    """JSON replies of a judge; every third has a foreign field and is dropped."""
    rows = table(spark, d, "judge_scores").select("score_id", "score").distinct()
    extra = F.when(F.col("score_id") % 3 == 0, F.lit(', "note": "x"')).otherwise(F.lit(""))
    replies = rows.select("score_id", F.concat(F.lit('{"score": '), F.coalesce(F.col("score").cast("string"), F.lit("null")), extra, F.lit("}")).alias("reply"))
    return G.parse_replies(replies, "reply", "score").select("score_id", F.col("score").alias("parsed"))


# --- files -----------------------------------------------------------------------------------------------------------


@query(
    _WITH + ", n AS (SELECT *, row_number() OVER (PARTITION BY dataset_idx ORDER BY split DESC, sample_idx)-1 AS k FROM s)"
    " SELECT dataset_idx, k AS sample_idx, split, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM n"
)
def json_roundtrip(spark, d):
    """The whole series written as one JSON document and read again."""
    path = f"{shared_folder(spark)}/prefloom-{uuid.uuid4().hex}.json"
    json_io.write_json(samples(spark, d), table(spark, d, "tasks"), path)
    back = cut(json_io.read_json(spark, path)[0], "series")
    delete(spark, path)
    return back.select("dataset_idx", "sample_idx", "split", *(F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")))


@query(
    "WITH p AS (SELECT 'runs/task-'||(vec_id%7)::varchar||'/checkpoint-'||(vec_id*100)::varchar AS path FROM embeddings UNION ALL SELECT 'runs/task-'||(vec_id%7)::varchar||'/logs' FROM embeddings)"
    " SELECT path, 'task-'||split_part(split_part(path,'/',2),'-',2) AS run, split_part(path,'/',3) AS checkpoint FROM p WHERE contains(path,'checkpoint') ORDER BY path"
)
def checkpoint_order(spark, d):
    """Checkpoints in textual order."""
    v = table(spark, d, "embeddings").select("vec_id")
    base = F.concat(F.lit("runs/task-"), (F.col("vec_id") % 7).cast("string"))
    paths = v.select(F.concat(base, F.lit("/checkpoint-"), (F.col("vec_id") * 100).cast("string")).alias("path")).union(v.select(F.concat(base, F.lit("/logs"))))
    return M.checkpoint_order(paths)


@query("SELECT DISTINCT source, split_part(split_part('hub/'||source||'.v1.json','/',-1),'.',1) AS name FROM documents WHERE source IS NOT NULL")
def dataset_names(spark, d):
    """Names cut from paths."""
    s = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return s.select("source", text.clean_dataset_name(F.concat(F.lit("hub/"), "source", F.lit(".v1.json"))).alias("name"))


# --- rollouts --------------------------------------------------------------------------------------------------------

_GAMMA, _LAM = 0.99, 0.95


@query(
    f"WITH RECURSIVE {ROLLOUT_SQL}, x AS (SELECT user_id, i, r, v, coalesce(lead(v) OVER w, 0) AS nv, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),"
    f" a AS (SELECT user_id, i, b, v, r+{_GAMMA}::double*nv-v AS g FROM x WHERE b=1 UNION ALL SELECT x.user_id, x.i, x.b, x.v, x.r+{_GAMMA}::double*x.nv-x.v+{_GAMMA * _LAM}::double*a.g FROM a JOIN x ON x.user_id=a.user_id AND x.b=a.b+1)"
    " SELECT user_id, i::int AS t, round(g,6) AS advantage, round(g+v,6) AS return_t FROM a"
)
def gae(spark, d):
    """Generalised advantage estimates and returns."""
    r = rollouts(spark, d)
    adv = rollout.advantages(F.col("r"), F.col("v"), _GAMMA, _LAM)
    both = r.withColumn("a", adv).withColumn("q", rollout.returns(F.col("a"), F.col("v")))
    return both.select("user_id", F.posexplode(F.arrays_zip("a", "q")).alias("t", "x")).select("user_id", "t", F.round("x.a", 6).alias("advantage"), F.round("x.q", 6).alias("return_t"))


@query(
    f"WITH {ROLLOUT_SQL}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1) SELECT user_id, i::int AS t, round(CASE WHEN i = CASE WHEN (user_id % n)+1 < n THEN (user_id % n)+1 ELSE user_id % n END THEN r+1 ELSE r END,9) AS reward FROM e JOIN n USING (user_id)"
)
def terminal_score(spark, d):
    """A score of 1 added at the end of each rollout's tokens."""
    r = rollouts(spark, d).withColumn("len", F.col("user_id") % F.col("n"))
    return r.select("user_id", F.posexplode(rollout.add_terminal_score(F.col("r"), F.col("len"), F.lit(1.0))).alias("t", "reward")).withColumn("reward", F.round("reward", 9))


@query(f"WITH {ROLLOUT_SQL}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1) SELECT user_id, i::int AS t, round(CASE WHEN i > user_id % n THEN 1 ELSE r END,9) AS logprob, round(CASE WHEN i > (user_id % n)+1 THEN 0 ELSE v END,9) AS value FROM e JOIN n USING (user_id)")
def padding_masks(spark, d):
    """places after the end get their fill values."""
    r = rollouts(spark, d).withColumn("len", F.col("user_id") % F.col("n"))
    z = F.arrays_zip(rollout.mask_after(F.col("r"), F.col("len"), rollout.INVALID_LOGPROB).alias("a"), rollout.mask_after(F.col("v"), F.col("len"), 0.0, 1).alias("b"))
    return r.select("user_id", F.posexplode(z).alias("t", "x")).select("user_id", "t", F.round("x.a", 9).alias("logprob"), F.round("x.b", 9).alias("value"))


_TOKENS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, (event_id % 50)::int AS tok FROM events WHERE user_id IS NOT NULL)"


def _responses(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null")
    grouped = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("a"))
    return grouped.select("user_id", F.transform("a", lambda x: (x["event_id"] % 50).cast("int")).alias("tok"))


@query(f"WITH {_TOKENS}, f AS (SELECT user_id, min(i) AS stop FROM e WHERE tok=7 GROUP BY 1) SELECT user_id, i::int AS t, CASE WHEN i > stop THEN -1 ELSE tok END AS tok FROM e LEFT JOIN f USING (user_id)")
def truncate_responses(spark, d):
    """padding after the first stop token."""
    return _responses(spark, d).select("user_id", F.posexplode(rollout.truncate_response(F.col("tok"), 7, -1)).alias("t", "tok"))


@query(f"WITH {_TOKENS} SELECT user_id, CASE WHEN bool_or(tok=7) THEN 1.0::double ELSE 1.0::double-0.25::double END AS score FROM e GROUP BY 1")
def missing_eos(spark, d):
    """F8: a penalty for responses that never end."""
    return _responses(spark, d).select("user_id", rollout.missing_eos_penalty(F.lit(1.0), F.col("tok"), 7, 0.25).alias("score"))


@query(
    f"WITH {ROLLOUT_SQL}, u AS (SELECT user_id, sum(r-v) AS kl, -sum(r) AS h FROM e GROUP BY 1) SELECT round(avg(kl),6) AS kl, round(avg(h),6) AS entropy, round(avg(-0.05::double*kl),6) AS non_score_reward, 0.5::double AS scores, round(avg(-0.05::double*kl)+0.5,6) AS rlhf_reward FROM u"
)
def rollout_metrics(spark, d):
    """The batch's KL, entropy and reward means."""
    return _rounded(rollout.objective_metrics(rollouts(spark, d).withColumn("s", F.lit(0.5)), "r", "v", "s", 0.05), 6)


@query(
    f"WITH {ROLLOUT_SQL}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), x AS (SELECT e.*, i <= user_id % n AS inside FROM e JOIN n USING (user_id)), m AS (SELECT avg(r) AS m, var_samp(r) AS s FROM x WHERE inside)"
    " SELECT user_id, i::int AS t, round(CASE WHEN inside THEN (r-m)/sqrt(s+1e-8::double) ELSE 0 END,6) AS whitened FROM x, m"
)
def whiten(spark, d):
    """Whitening over a whole batch under a mask."""
    r = rollouts(spark, d).withColumn("len", F.col("user_id") % F.col("n"))
    return rollout.whiten(r, "r", "len", "w").select("user_id", F.posexplode("w").alias("t", "whitened")).withColumn("whitened", F.round("whitened", 6))


@query(
    f"WITH {ROLLOUT_SQL}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), x AS (SELECT e.*, n, i <= user_id % n AS inside FROM e JOIN n USING (user_id)),"
    " g AS (SELECT user_id, avg(v) AS lm, stddev_samp(v) AS ls, avg(r) AS rm, stddev_samp(r) AS rs, sum(CASE WHEN inside THEN v ELSE 0 END)/count(*) FILTER (inside) AS lp, max(CASE WHEN i = user_id % n THEN r END) AS last FROM x GROUP BY 1),"
    " b AS (SELECT user_id, coalesce(last > rm+0.5::double*rs,false) AS hr, coalesce(last < rm-0.5::double*rs,false) AS lr, coalesce(lp > lm+0.5::double*ls,false) AS hp, coalesce(lp < lm-0.5::double*ls,false) AS lw FROM g)"
    " SELECT user_id, CASE WHEN hr AND (hp OR lw) THEN 2.0::double WHEN lr AND hp THEN 2.0::double WHEN lr AND lw THEN 0.2::double ELSE 1.0::double END AS learn,"
    " CASE WHEN hr AND hp THEN 2.0::double WHEN (hr AND lw) OR (lr AND (hp OR lw)) THEN 0.2::double ELSE 1.0::double END AS reg FROM b"
)
def plasticity(spark, d):
    """Learning and regularisation weights of each rollout."""
    r = rollouts(spark, d).withColumn("mask", F.transform("r", lambda x, i: i <= F.col("user_id") % F.col("n")))
    return r.select("user_id", rollout.plasticity(F.col("v"), F.col("r"), F.col("mask")).alias("p")).select("user_id", "p.learn", "p.reg")


@query(
    f"WITH {ROLLOUT_SQL}, x AS (SELECT user_id, i, exp(r-v) AS ratio, v-0.1 AS a, r, v FROM e)"
    " SELECT user_id, i::int AS t, round(greatest(-a*ratio, -a*greatest(0.8::double,least(1.2::double,ratio))),6) AS policy_loss, (-a*greatest(0.8::double,least(1.2::double,ratio))) > (-a*ratio) AS clipped,"
    " round(0.5*greatest(power(r-0.3::double,2), power(greatest(v-0.2::double,least(v+0.2::double,r))-0.3::double,2)),6) AS value_loss FROM x"
)
def ppo_losses(spark, d):
    """2.11: clipped policy and value losses of each token."""
    r = rollouts(spark, d).withColumn("adv", F.transform("v", lambda x: x - F.lit(0.1))).withColumn("ret", F.transform("v", lambda x: F.lit(0.3)))
    z = F.arrays_zip(rollout.policy_losses(F.col("r"), F.col("v"), F.col("adv"), 0.2).alias("p"), rollout.value_losses(F.col("r"), F.col("v"), F.col("ret"), 0.2).alias("q"))
    return r.select("user_id", F.posexplode(z).alias("t", "x")).select("user_id", "t", F.round("x.p.loss", 6).alias("policy_loss"), F.col("x.p.clipped").alias("clipped"), F.round("x.q", 6).alias("value_loss"))


@query(
    f"WITH {ROLLOUT_SQL}, x AS (SELECT exp(r-v) AS ratio, v-0.1 AS a, r, v FROM e), y AS (SELECT ratio, r, v, -a*ratio AS plain, -a*greatest(0.8::double,least(1.2::double,ratio)) AS bound,"
    " 0.5*power(r-0.3::double,2) AS q, 0.5*power(greatest(v-0.2::double,least(v+0.2::double,r))-0.3::double,2) AS w FROM x)"
    " SELECT round(avg(greatest(plain,bound)),6) AS policy_loss, round(avg(greatest(q,w)),6) AS value_loss, round(avg(0.5*(r-v)*(r-v)),6) AS approx_kl, round(avg((bound>plain)::int),6) AS policy_clipped,"
    " round(avg((w>q)::int),6) AS value_clipped, round(avg(ratio),6) AS ratio_mean, round(var_samp(ratio),6) AS ratio_var FROM y"
)
def update_metrics(spark, d):
    """Losses, approximate KL, clipped shares and the ratio's moments of a batch of updates."""
    r = rollouts(spark, d).withColumn("adv", F.transform("v", lambda x: x - F.lit(0.1))).withColumn("ret", F.transform("v", lambda x: F.lit(0.3)))
    return _rounded(rollout.update_metrics(r, "r", "v", "adv", "r", "v", "ret", 0.2, 0.2), 6)


@query(f"WITH {_TOKENS} SELECT count(*) FILTER (tok=7)::bigint AS num_eos_tokens FROM e")
def eos_tokens(spark, d):
    """End tokens of the batch."""
    r = _responses(spark, d).withColumn("zero", F.transform("tok", lambda x: F.lit(0.0))).withColumn("score", F.lit(0.0))
    return rollout.objective_metrics(r, "zero", "zero", "score", 0.05, "tok", 7).select("num_eos_tokens")


# --- metrics ---------------------------------------------------------------------------------------------------------

_METRICS = "m AS (SELECT CASE WHEN event_id%2=0 THEN 'train' ELSE 'eval' END AS split, CASE WHEN event_id%5=0 THEN NULL ELSE 'task-'||(user_id%4)::varchar END AS task, event_id%6=1 AS is_final, event_type AS key, value FROM events)"


@query(
    f"WITH {_METRICS}, k AS (SELECT split, key, value FROM m UNION ALL SELECT 'task', 'task/'||task||'/'||key, value FROM m WHERE task IS NOT NULL UNION ALL SELECT 'eval.last', 'eval.last/'||key, value FROM m WHERE split='eval' AND is_final)"
    " SELECT split, key, round(avg(value),6) AS value, count(value) AS n FROM k GROUP BY ALL"
)
def metric_rollup(spark, d):
    """Means by key, task and final evaluation."""
    e = table(spark, d, "events")
    m = e.select(
        F.when(F.col("event_id") % 2 == 0, "train").otherwise("eval").alias("split"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("task-"), (F.col("user_id") % 4).cast("string"))).alias("task"),
        (F.col("event_id") % 6 == 1).alias("is_final"), F.col("event_type").alias("key"), "value",
    )
    return _rounded(M.metric_rollup(m), 6)


@query("SELECT (user_id%4)::int AS dataset_idx, 'dataset-'||(user_id%4)::varchar||'/'||event_type AS key, round(avg(value),6) AS value FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def prefixed_metrics(spark, d):
    """Keys with their dataset."""
    e = table(spark, d, "events").where("user_id is not null").groupBy((F.col("user_id") % 4).cast("int").alias("dataset_idx"), F.col("event_type").alias("key")).agg(F.avg("value").alias("value"))
    return _rounded(M.prefixed(e), 6)


@query("WITH e AS (SELECT (event_id%4)::int AS dataset_idx, row_number() OVER (PARTITION BY event_id%4 ORDER BY event_id)-1 AS i, count(*) OVER (PARTITION BY event_id%4) AS n, value FROM events) SELECT dataset_idx, round(avg(value),6) AS mean_reward, count(value) AS used FROM e WHERE i < (n//48)*48 GROUP BY 1")
def mean_eval_reward(spark, d):
    """Means over full batches."""
    from prefloom.operators.ordered import rank_within

    e = table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("dataset_idx"), "event_id", F.col("value").alias("score"))
    e = rank_within(e, ["dataset_idx"], "event_id", ["event_id"], "k").withColumn("row_idx", F.col("k") - 1)
    return _rounded(M.mean_eval_reward(e, 48), 6)


@query("SELECT l_shipdate::date::varchar AS name, round(sum(l_extendedprice),2) AS importance FROM lineitem GROUP BY 1 ORDER BY round(sum(l_extendedprice),2) DESC, name LIMIT 20")
def top_importance(spark, d):
    """L1: the twenty names with the greatest sums."""
    rows = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("name"), F.col("l_extendedprice").cast("decimal(18,4)").alias("value"))
    return M.top_importance(rows.groupBy("name").agg(F.round(F.sum("value"), 2).cast("double").alias("value"))).select("name", F.round("importance", 2).alias("importance"))


@query("SELECT label::varchar AS name, k AS idx, round(avg(x*x),9) AS value FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding,1)::int-1 AS k FROM embeddings) GROUP BY ALL")
def fisher_information(spark, d):
    """Mean squared gradients (embeddings stand in for gradients)."""
    g = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("idx", "grad")).withColumn("grad", F.col("grad").cast("double"))
    return _rounded(M.importance_from_gradients(g))


@query(
    "WITH x AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding,1) AS k FROM embeddings), f AS (SELECT label, k, avg(abs(x)) AS f FROM x GROUP BY ALL), a AS (SELECT label, k, avg(x) AS a, max(x) AS b FROM x GROUP BY ALL)"
    " SELECT round(0.7::double*sum(f*(b-a)*(b-a)),6) AS penalty FROM f JOIN a USING (label,k)"
)
def drift_penalty(spark, d):
    """Importance-weighted squared drift."""
    g = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))
    theta = lambda f: g.groupBy("name", "idx").agg(f("x").alias("theta"))
    return _rounded(M.drift_penalty(M.importance_from_gradients(g.withColumnRenamed("x", "grad"), "mas"), theta(F.avg), theta(F.max), 0.7, "mas"), 6)


@query(_WITH + "SELECT (k-1)::bigint AS row_idx, sha256(prompt) AS query, sha256(chosen) AS response, sample_id::double AS score FROM (SELECT *, row_number() OVER (ORDER BY dataset_idx, sample_idx) AS k FROM s WHERE split='test') WHERE k <= 16")
def completions(spark, d):
    """K9: the first evaluation batch as a table."""
    s = X.with_global_index(samples(spark, d).where("split = 'test'"))
    rows = s.select(F.col("global_idx").cast("long").alias("row_idx"), F.sha2("prompt", 256).alias("query"), F.sha2("chosen", 256).alias("response"), F.col("sample_id").cast("double").alias("score"))
    return M.completions(rows, 16)


@query("WITH m AS (SELECT DISTINCT dataset_idx, 'rewards/task-'||dataset_idx::varchar AS model FROM tasks WHERE dataset_idx%2=0) SELECT t.dataset_idx, t.objective, model FROM tasks t JOIN m USING (dataset_idx)")
def reward_model_join(spark, d):
    """Tasks and the reward models with their index."""
    t = table(spark, d, "tasks")
    models = t.where("dataset_idx % 2 = 0").select("dataset_idx", F.concat(F.lit("rewards/task-"), F.col("dataset_idx").cast("string")).alias("model"))
    return t.select("dataset_idx", "objective").join(models, "dataset_idx")


@query(
    _WITH + ", c AS (SELECT *, CASE WHEN contains(lower(prompt),'r/relationships') THEN 0 ELSE 1 END AS i FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY i, split ORDER BY sample_id) AS k FROM c),"
    + f" m AS (SELECT *, CASE i WHEN 0 THEN CASE split WHEN 'train' THEN {C.TASK_LIMITS['relationships'][0]} ELSE {C.TASK_LIMITS['relationships'][1]} END ELSE CASE split WHEN 'train' THEN {C.TASK_LIMITS['others'][0]} ELSE {C.TASK_LIMITS['others'][1]} END END AS most,"
    + f" CASE WHEN split='train' THEN CASE i WHEN 0 THEN {C.TASK_LIMITS['relationships'][2]} ELSE {C.TASK_LIMITS['others'][2]} END ELSE 0 END AS back FROM k)"
    + f" SELECT 'reward' AS purpose, i::int AS dataset_idx, split, sample_id FROM m WHERE k <= most AND chosen <> rejected AND {_LEN('chosen')} >= 5 AND {_LEN('rejected')} >= 5 UNION ALL SELECT 'rl', i::int, split, sample_id FROM m WHERE k <= most - back"
)
def task_corpora(spark, d):
    """The corpora of the two-task series, for reward models and for reinforcement learning."""
    return C.task_corpora(samples(spark, d, "sample_id", "split", "prompt", "chosen", "rejected"), "sample_id").select("purpose", "dataset_idx", "split", "sample_id")


# --- losses, chat, tokens --------------------------------------------------------------------------------------------

def _pairs(spark, d) -> DataFrame:
    rows = table(spark, d, "judge_scores").select("score_id", "sample_id", "score").distinct()
    c = rows.select("score_id", "sample_id", (F.col("score").cast("double") / 10).alias("c"))
    follow = c.select((F.col("score_id") - 1).alias("score_id"), F.col("c").alias("r"))
    return c.join(follow, "score_id", "left")


_NEXT = "p AS (SELECT a.score_id, a.sample_id, a.score::double/10 AS c, b.score::double/10 AS r FROM (SELECT DISTINCT score_id, sample_id, score FROM judge_scores) a LEFT JOIN (SELECT DISTINCT score_id, sample_id, score FROM judge_scores) b ON b.score_id=a.score_id+1)"


@query(f"WITH {_NEXT} SELECT score_id, round(ln(1+exp(-(c-r))),9) AS loss, round(CASE WHEN c IS NULL OR r IS NULL THEN 0.9 ELSE exp(c)/(exp(c)+exp(r)) END,9) AS p_chosen, round(CASE WHEN c IS NULL OR r IS NULL THEN 0.1 ELSE exp(r)/(exp(c)+exp(r)) END,9) AS p_rejected FROM p")
def preference_losses(spark, d):
    """2.11: pair loss and reward probabilities."""
    p = _pairs(spark, d)
    soft = preference.reward_softmax(F.col("c"), F.col("r"))
    out = p.select("score_id", preference.pair_loss(F.col("c"), F.col("r")).alias("loss"), soft["chosen"].alias("p_chosen"), soft["rejected"].alias("p_rejected"))
    return _rounded(out)


@query(
    f"WITH {_NEXT}, q AS (SELECT *, score_id%2=0 AS new, power(c-0.3::double,2)+power(r-0.2::double,2) AS gap FROM p WHERE c IS NOT NULL AND r IS NOT NULL), z AS (SELECT avg(ln(1+exp(-(c-r)))) AS dpo, avg(CASE WHEN new THEN gap END) AS rdpo, avg(CASE WHEN NOT new THEN gap END) AS reg FROM q)"
    " SELECT round(dpo,9) AS dpo_loss, round(rdpo,9) AS rdpo_loss, round(reg,9) AS reg_loss, round((0.8::double*rdpo+0.5::double/1.5*reg+dpo)/1.5,9) AS loss, round(0.0001::double*0.5*(reg-0.1::double),12) AS log_lambda_step FROM z"
)
def constrained_loss(spark, d):
    """2.11: fitting, regularisation and multiplier step of a batch."""
    p = _pairs(spark, d).where("c is not null and r is not null")
    p = p.select((F.col("score_id") % 2 == 0).alias("new"), F.col("c").alias("chosen"), F.col("r").alias("rejected"), F.lit(0.3).alias("ref_chosen"), F.lit(0.2).alias("ref_rejected"))
    out = preference.constrained_loss(p, "new", 0.5)
    return out.select(*(F.round(c, 9).alias(c) for c in ("dpo_loss", "rdpo_loss", "reg_loss", "loss")), F.round("log_lambda_step", 12).alias("log_lambda_step"))


def _chats(spark, d) -> DataFrame:
    s = samples(spark, d, "sample_id", "prompt", "chosen", "rejected")
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return s.select("sample_id", F.array(m("user", "prompt"), m("assistant", "chosen")).alias("c"), F.array(m("user", "prompt"), m("assistant", "rejected")).alias("r"))


@query(
    _WITH + "SELECT sample_id, (CASE WHEN chosen=rejected THEN 2 ELSE 1 END)::int AS prompt_turns, md5(prompt||CASE WHEN chosen=rejected THEN chosen ELSE '' END) AS prompt_md5, md5(CASE WHEN chosen=rejected THEN '' ELSE chosen END) AS chosen_md5, md5(CASE WHEN chosen=rejected THEN '' ELSE rejected END) AS rejected_md5 FROM s"
)
def extract_prompts(spark, d):
    """The shared start of two conversations as prompt."""
    x = _chats(spark, d).select("sample_id", chat.extract_prompt(F.col("c"), F.col("r")).alias("x"))
    body = lambda c: F.md5(F.array_join(F.transform(F.col(f"x.{c}"), lambda m: m["content"]), ""))
    return x.select("sample_id", F.size("x.prompt").alias("prompt_turns"), *(body(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")))


@query(_WITH + r"SELECT sample_id, md5('<eos>'||'\n'||'\n'||'<|user|>'||chr(10)||prompt||'\n'||'\n'||'\n'||'\n'||'\n'||'<|assistant|>'||chr(10)||chosen||'<eos>'||'\n'||'\n'||'\n') AS rendered_md5 FROM s")
def chat_template(spark, d):
    """Conversations rendered by the chat template."""
    return _chats(spark, d).select("sample_id", F.md5(chat.apply_chat_template(F.col("c"), "<eos>")).alias("rendered_md5"))


@query()
def token_ids(spark, d):
    """Token ids of the texts, other columns dropped."""
    return M.tokenize(samples(spark, d, "sample_id", "prompt", "chosen", "rejected"), ["sample_id"], ["prompt", "chosen", "rejected"], "/opt/tokenizers/byte_bpe_50k.json")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
