"""Problem 6: the reading level of each text, and texts that don't suit the reader asked for.

Method: the labelled texts give every word a distribution over the grades in which it is used,
and from it the grade at which it is acquired.  A sentence's level comes from calibrated
quantiles of its known words' grades; a document has the level of most of its text.  The model is
fitted on the labelled table alone (bounded by ``MAX_EXAMPLES`` rows); it is a few thousand
numbers, so it travels in the closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.llm._lang import LANGS, text_votes
from prefloom.llm.pair_defects import response_defects
from prefloom.session import arrow_map, small

LEVELS = ("child", "school", "expert")
#: Labelled rows used to fit, in order of id; more are a sample of this size.
MAX_EXAMPLES = 20_000
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_END = frozenset(".?!;")


@dataclass
class LevelModel:
    """Sorted word hashes with their acquisition grades, and the calibration of grade quantiles."""

    keys: np.ndarray
    grades: np.ndarray
    weights: np.ndarray  # levels x (quantiles, 1)


def sentences(w: W.Words) -> np.ndarray:
    """Index of the sentence each word stands in, rising over the whole batch."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64)
    chars = np.frombuffer(w.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.isin(chars, [ord(c) for c in _END])
    total = np.concatenate(([0], np.cumsum(ends)))
    breaks = np.zeros(n, dtype=np.int64)
    breaks[1:] = total[w.start[1:]] > total[w.end[:-1]]
    return np.cumsum(breaks)


def features(grades: np.ndarray, known: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grade quantiles of each group's known words with a constant, and the number of known words."""
    n = int(group[-1]) + 1 if len(group) else 0
    order = np.lexsort((grades[known], group[known]))
    g, owner = grades[known][order], group[known][order]
    first = np.searchsorted(owner, np.arange(n + 1))
    count = np.diff(first)
    out = np.zeros((n, len(QUANTILES) + 1))
    some = count > 0
    for i, q in enumerate(QUANTILES):
        at = first[:-1] + np.minimum((q * count).astype(np.int64), np.maximum(count - 1, 0))
        out[some, i] = g[at[some]]
    out[:, -1] = 1
    return out, count


def grade(model: LevelModel, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(model.keys):
        return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(model.keys, hashes), len(model.keys) - 1)
    return model.grades[at], model.keys[at] == hashes


def fit(texts: list[str | None], levels: list[str]) -> LevelModel:
    """Fit word grades and the calibration on labelled texts; unknown labels and null texts are left out."""
    keep = [i for i, (t, v) in enumerate(zip(texts, levels, strict=True)) if t and v in LEVELS]
    y = np.array([LEVELS.index(levels[i]) for i in keep], dtype=np.int64)
    w = W.words([texts[i] for i in keep])
    label = y[w.owner()] if len(keep) else np.zeros(0, np.int64)
    keys, inverse = np.unique(w.hashes, return_inverse=True)
    counts = np.zeros((len(keys), len(LEVELS)))
    np.add.at(counts, (inverse, label), 1)
    # documents, not tokens, so that one text cannot grade a word alone
    pairs = np.unique(np.stack([inverse, w.owner()], axis=1), axis=0) if len(keep) else np.zeros((0, 2), np.int64)
    docs = np.zeros((len(keys), len(LEVELS)))
    np.add.at(docs, (pairs[:, 0], y[pairs[:, 1]] if len(pairs) else []), 1)
    per = np.maximum(np.bincount(y, minlength=len(LEVELS)), 1)
    rate = (docs + 0.3) / (per + 1)
    share = rate / rate.sum(axis=1, keepdims=True) if len(keys) else rate
    grades = share @ np.arange(1, len(LEVELS) + 1)
    model = LevelModel(keys, grades, np.zeros((len(LEVELS), len(QUANTILES) + 1)))
    if not len(keep):
        return model
    g, known = grade(model, w.hashes)
    s = sentences(w)
    s = np.unique(s + w.owner() * (s.max() + 1), return_inverse=True)[1]
    x, n = features(g, known, s)
    first_word = np.searchsorted(s, np.arange(len(x)))
    target = label[first_word]
    use = n > 0
    x, target, n = x[use], target[use], n[use]
    goal = np.eye(len(LEVELS))[target]
    theta = np.zeros((len(LEVELS), x.shape[1]))
    scale = np.minimum(n, 30)[:, None] / np.minimum(n, 30).sum()
    for _ in range(3000):  # convex: plain gradient steps with a little weight decay
        z = x @ theta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        theta += 1.5 * ((goal - p) * scale).T @ x - 1e-4 * theta
    model.weights = theta
    return model


def predict(model: LevelModel, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(level number or -1, share of the text in that level) of each text."""
    n = len(w.first) - 1
    if not len(w.hashes):
        return np.full(n, -1), np.zeros(n)
    g, known = grade(model, w.hashes)
    owner = w.owner()
    s = sentences(w)
    s = np.cumsum(np.concatenate(([0], (np.diff(s) > 0) | (np.diff(owner) > 0))))
    x, count = features(g, known, s)
    level = (x @ model.weights.T).argmax(axis=1)
    # the root of its words, so that one long sentence doesn't outvote many short ones
    weight = np.where(count > 0, np.sqrt(np.bincount(s, minlength=len(x))), 0)
    text = owner[np.searchsorted(s, np.arange(len(x)))]
    total = np.zeros((n, len(LEVELS)))
    np.add.at(total, (text, level), weight)
    best = total.argmax(axis=1)
    share = total[np.arange(n), best] / np.maximum(total.sum(axis=1), 1)
    return np.where(total.sum(axis=1) > 0, best, -1), share


def fit_levels(examples: DataFrame, text: str = "text", level: str = "reading_level", order: str = "example_id") -> LevelModel:
    """Fit on at most ``MAX_EXAMPLES`` labelled rows; a table without usable rows gives a model that knows no word."""
    rows = examples.where(F.col(text).isNotNull()).orderBy(F.xxhash64(order), order).limit(MAX_EXAMPLES).select(text, level).collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


_NUMBERS = {n: i for i, n in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split())}
_ORDINALS = {n: i for i, n in enumerate("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split())}
_SCHOOL_FIRST = re.compile(r"general (?:newspaper|reader|public|audience)|newspaper|magazine|lay(?:person|man|people)?\b|without (?:any )?(?:special|prior|technical)|no (?:special|prior) |non-?(?:specialist|expert)|amateur|curious (?:adult|reader)|interested adult|everyday reader")
_EXPERT = re.compile(r"research(?:er)?s?\b|specialists?|journal|doctora\w+|ph\.?d|technical register|scholar\w*|professors?|peer[- ]review|experts?|academic\w*|scientists?|postgraduate|graduate (?:student|seminar)|discipline|practitioners?|learned society|faculty|dissertation|published in")
_CHILD = re.compile(r"\bkids?\b|kindergarten|little ones?|toddlers?|pre-?school\w*|bedtime|young(?:er)? child\w*|small child\w*|very young|learned to read|learning to read|beginning reader|primary[- ]school|elementary[- ]school|nursery|\btots?\b|picture book|first year of school|\bchild(?:ren)?\b")
_SCHOOL = re.compile(r"teen\w*|secondary[- ]school|high[- ]school|middle[- ]school|pupils?|youth\w*|adolescents?|schoolbook|textbook|grammar school|\bstudents?\b|\badults?\b|school class|young adult|classroom")
_AGE = re.compile(r"\b(\d{1,2}|" + "|".join(_NUMBERS) + r")[- ]years?[- ]old|\b(?:is|are|aged|age|about|of|around) (\d{1,2}|" + "|".join(_NUMBERS) + r")\b(?! per)")
_GRADE = re.compile(r"\b(\d{1,2})(?:st|nd|rd|th)[- ]grade|\b(" + "|".join(_ORDINALS) + r")[- ]grade|\bgrade (\d{1,2})\b")


def asked_level(preference: str | None) -> str | None:
    """The level of the reader a preference names, or None if it names none."""
    if not preference:
        return None
    t = preference.lower()
    m = _GRADE.search(t)
    if m:
        n = int(m.group(1) or m.group(3) or _ORDINALS[m.group(2) or "zeroth"])
        return "child" if n <= 4 else "school"
    m = _AGE.search(t)
    if m:
        word = m.group(1) or m.group(2)
        n = int(word) if word.isdigit() else _NUMBERS[word]
        if 2 <= n <= 10:
            return "child"
        if n <= 19:
            return "school"
    for pattern, level in ((_SCHOOL_FIRST, "school"), (_EXPERT, "expert"), (_CHILD, "child"), (_SCHOOL, "school")):
        if pattern.search(t):
            return level
    return None


def _levels(batches: Iterator[pa.RecordBatch], model: LevelModel) -> Iterator[pa.RecordBatch]:
    english = LANGS.index("en")
    for batch in batches:
        texts = batch.column(1).to_pylist()
        level, share, in_english = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            a, b = predict(model, w)
            v = text_votes(w)
            level.append(a)
            share.append(b)
            in_english.append((v.argmax(axis=1) == english) & (v[:, english] >= 0.5 * v.sum(axis=1)) & (v[:, english] > 0))
        names = [LEVELS[i] if i >= 0 else None for i in np.concatenate(level).tolist()]
        yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(share)), pa.array(np.concatenate(in_english))], ["id", "reading_level", "share", "english"])


def reading_levels(rows: DataFrame, model: LevelModel, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, reading_level, share, english) for each id.

    Repeated ids count once (their content is the same); null and empty texts, and texts without a known word, have a null
    level; null ids are dropped.
    """
    rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, lambda it: _levels(it, model), f"id {kind}, reading_level string, share double, english boolean")
    return out.dropDuplicates(["id"]).withColumnRenamed("id", id_col)


def asked_levels(tasks: DataFrame) -> DataFrame:
    """(dataset_idx, asked) for the tasks whose preference names a reader; one row a task, so it is collected."""
    spark = tasks.sparkSession
    rows = tasks.select("dataset_idx", "preference").distinct().collect()
    data = [(r[0], asked_level(r[1])) for r in rows if r[0] is not None and asked_level(r[1])]
    return spark.createDataFrame(data, "dataset_idx int, asked string")


def unsuited_levels(samples: DataFrame, tasks: DataFrame, examples: DataFrame) -> DataFrame:
    """Samples whose chosen text is of another level than the reader their task names.

    Returns (sample_id, dataset_idx, asked, reading_level).  Only English, defect-free answers count (a truncated one
    does).  Samples of unknown datasets are left out; an empty table gives an empty result.
    """
    model = fit_levels(examples)
    asked = asked_levels(tasks)
    rows = samples.select("sample_id", "dataset_idx", "prompt", "chosen").join(small(asked, 64), "dataset_idx")
    levels = reading_levels(rows, model, "sample_id", "chosen").where("english and reading_level is not null")
    defective = response_defects(rows, "sample_id", "prompt", ("chosen",)).select("sample_id").distinct()
    datasets = rows.select("sample_id", "dataset_idx", "asked").dropDuplicates(["sample_id"])
    return (
        levels.join(datasets, "sample_id")
        .where("reading_level <> asked")
        .join(defective, "sample_id", "left_anti")
        .select("sample_id", "dataset_idx", "asked", "reading_level")
    )


def level_profile(samples: DataFrame, examples: DataFrame) -> DataFrame:
    """Per dataset and level (null: no known word): samples and their mean share of text in that level."""
    levels = reading_levels(samples, fit_levels(examples), "sample_id", "chosen")
    datasets = samples.select("sample_id", "dataset_idx").dropDuplicates(["sample_id"])
    return levels.join(datasets, "sample_id").groupBy("dataset_idx", "reading_level").agg(F.count("*").alias("samples"), F.round(F.avg("share"), 6).alias("mean_share"))
