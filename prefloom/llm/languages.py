"""Problem 9: the language of each document and of each part of a mixed one.

Method: multilingual mixture inference.  Character-trigram models give every word a likelihood in
each language; expectation-maximisation estimates each document's language proportions over its
sentences.  The language set is chosen by penalised likelihood: from the best single language on, that language joins which
raises the likelihood of the best path over the words most, less what its changes of language and the language itself cost; the path of
the set chosen gives the parts.

The models are fitted on a bounded sample of labelled documents (``MAX_TRAIN``): labels are taken
first, then each sentence's language is re-estimated, so wrong labels and mixed documents wash out.
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
from prefloom.llm._lang import FUNCTION_WORDS, LANGS, text_votes
from prefloom.session import arrow_map

#: Documents in the training sample (whole texts), buckets of the trigram tables, re-estimation rounds.
MAX_TRAIN, BUCKETS, ROUNDS = 4000, 1 << 16, 3
#: A part has at least this many words.
LEAST = 8
#: Log-likelihood a language must gain by itself to be tried, what one more in the set costs, and what a change of language costs within
#: and between sentences.
PENALTY, SET, INSIDE, BETWEEN = 10.0, 1.0, 14.0, 5.0
#: A word's log-likelihood falls at most this far below its best language, so that one name decides nothing.
FLOOR = 4.0
EM_STEPS = 12

#: Other ways of naming the languages (ISO 639-2 and -3 codes, English and own names).
LABELS = {
    "en": "en eng english englisch anglais inglés inglês engels",
    "de": "de deu ger german deutsch allemand alemán duits",
    "fr": "fr fra fre french français francais französisch frans",
    "es": "es spa spanish español espanol castellano spanisch espagnol spaans",
    "nl": "nl nld dut dutch nederlands flemish vlaams niederländisch néerlandais",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugees",
    "ru": "ru rus russian русский russisch russe",
}
_LABEL = {name: lang for lang, names in LABELS.items() for name in names.split()}


def label_language(label: str | None) -> str | None:
    """The language a label names, however written; None for missing, unusable and other labels."""
    if not label:
        return None
    return _LABEL.get(re.split(r"[-_\s(,;.]", label.strip().lower(), maxsplit=1)[0])


@dataclass
class TrigramModel:
    """Log-probability of each trigram bucket in each language."""

    table: np.ndarray


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' trigrams (with borders) and the first one of each word."""
    joined = "  " + "  ".join(words) + "  "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = W.mix((c[:-2] * np.uint64(0x10FFFF) + c[1:-1]) * np.uint64(0x10FFFF) + c[2:]) & np.uint64(BUCKETS - 1)
    inner = c[1:-1] != 32  # a letter in the middle
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return code[inner].astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1]))


def word_scores(model: TrigramModel, w: W.Words) -> np.ndarray:
    """Log-likelihood of every word in every language, relative to its best and floored."""
    if not len(w.hashes):
        return np.zeros((0, len(LANGS)), dtype=np.float32)
    _, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    text = w.text
    code, first = _trigrams([text[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
    score = np.add.reduceat(model.table[code], first, axis=0)
    score = np.maximum(score - score.max(axis=1, keepdims=True), -FLOOR)
    return score[inverse]


def sentence_starts(w: W.Words) -> np.ndarray:
    """True for each word that opens a sentence, a line or a text."""
    n = len(w.hashes)
    opens = np.zeros(n, dtype=bool)
    if n:
        chars = np.frombuffer(w.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.concatenate(([0], np.cumsum(np.isin(chars, [ord(x) for x in ".?!\n\"«»“”:"]))))
        opens[1:] = ends[w.start[1:]] > ends[w.end[:-1]]
        opens[w.first[:-1][w.counts > 0]] = True
    return opens


def fit(texts: list[str | None], labels: list[str | None]) -> TrigramModel:
    """Fit the trigram models on labelled texts; null and unusable labels still help in re-estimation."""
    k = len(LANGS)
    w = W.words(texts)
    counts = np.full((BUCKETS, k), 0.02)
    # a little mass from function words, so that a language without labelled texts has a model too
    for i, lang in enumerate(LANGS):
        code, _ = _trigrams(FUNCTION_WORDS[lang].split())
        np.add.at(counts[:, i], code, 0.5)
    if not len(w.hashes):
        return TrigramModel(np.log(counts / counts.sum(axis=0)).astype(np.float32))
    owner = w.owner()
    unit = np.cumsum(sentence_starts(w)) - 1
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    doc = owner[first]
    known = np.array([LANGS.index(v) if (v := label_language(x)) else -1 for x in labels])
    votes = text_votes(w)
    lang = known[doc]
    # a label that the document's function words contradict is left out at first
    contradicted = (votes.max(axis=1) >= 5) & (votes.argmax(axis=1) != known)
    lang[contradicted[doc]] = -1
    code, at = _trigrams([w.text[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)])
    sizes = np.diff(np.append(at, len(code)))
    table = counts
    for _ in range(ROUNDS):
        use = np.repeat(lang[unit], sizes)
        table = counts.copy()
        np.add.at(table, (code[use >= 0], use[use >= 0]), 1.0)
        model = TrigramModel(np.log(table / table.sum(axis=0)).astype(np.float32))
        score = np.add.reduceat(word_scores(model, w), first, axis=0)
        top = np.sort(score, axis=1)
        sure = top[:, -1] - top[:, -2] > 8
        lang = np.where(sure, score.argmax(axis=1), -1)
    return model


def _proportions(unit: np.ndarray, doc_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """EM over the units of each document: language proportions (documents x languages)."""
    n = len(doc_first)
    k = unit.shape[1]
    reps = np.diff(np.append(doc_first, len(unit)))
    p = np.full((n, k), 1.0 / k)
    like = np.exp(unit - unit.max(axis=1, keepdims=True))
    total = np.maximum(np.add.reduceat(size, doc_first), 1)[:, None]
    for _ in range(EM_STEPS):
        r = like * np.repeat(p, reps, axis=0) + 1e-300
        r *= (size / r.sum(axis=1))[:, None]
        p = np.add.reduceat(r, doc_first, axis=0) / total
    return p


def _viterbi(score: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, float]:
    """Best language index of each word, and the path's penalised likelihood; a change costs less where a sentence opens."""
    n, k = score.shape
    s = score.tolist()
    o = opens.tolist()
    best = s[0][:]
    back: list[list[int]] = []
    states = range(k)
    for i in range(1, n):
        top = max(states, key=best.__getitem__)
        jump = best[top] - (BETWEEN if o[i] else INSIDE)
        row = s[i]
        came = [j if best[j] >= jump else top for j in states]
        best = [(best[j] if best[j] >= jump else jump) + row[j] for j in states]
        back.append(came)
    at = max(states, key=best.__getitem__)
    value = best[at]
    out = [at]
    for came in reversed(back):
        at = came[at]
        out.append(at)
    return np.array(out[::-1]), value


def language_set(score: np.ndarray, opens: np.ndarray, best: int, candidates: list[int]) -> np.ndarray:
    """The language of each word within the set of greatest penalised likelihood, found by adding one language at a time."""
    chosen, path, value = [best], np.full(len(score), best), float(score[:, best].sum())
    left = list(candidates)
    while left:
        tried = []
        for j in left:
            some = [*chosen, j]
            at, v = _viterbi(score[:, some], opens)
            tried.append((v - SET, j, np.array(some)[at]))
        v, j, at = max(tried, key=lambda t: t[0])
        if v <= value:
            break
        chosen, path, value = [*chosen, j], at, v
        left = [x for x in left if x != j]
    return path


def _parts(lang: np.ndarray, score: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (start, end, language); stretches under LEAST words join a neighbour, the shortest first."""
    edge = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
    parts = [(a, b, int(lang[a])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    while len(parts) > 1:
        i = min(range(len(parts)), key=lambda j: parts[j][1] - parts[j][0])
        a, b, _ = parts[i]
        if b - a >= LEAST:
            break
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(parts)]
        to = max(near, key=lambda j: float(score[a:b, parts[j][2]].sum()))
        parts[i] = (a, b, parts[to][2])
        merged: list[tuple[int, int, int]] = []
        for p in parts:
            if merged and merged[-1][2] == p[2]:
                merged[-1] = (merged[-1][0], p[1], p[2])
            else:
                merged.append(p)
        parts = merged
    return parts


def document_parts(model: TrigramModel, w: W.Words) -> list[list[tuple[int, int, int, float]]]:
    """For each text its parts (first word, end word, language number, confidence)."""
    n = len(w.first) - 1
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
    docs = np.flatnonzero(w.counts > 0)
    if not len(docs):
        return out
    score = word_scores(model, w)
    opens = sentence_starts(w)
    first = np.flatnonzero(opens)
    unit = np.add.reduceat(score, first, axis=0)
    size = np.diff(np.append(first, len(score))).astype(np.float64)
    doc_first = np.searchsorted(first, w.first[:-1][docs])
    p = _proportions(unit, doc_first, size)
    whole = np.add.reduceat(unit, doc_first, axis=0)
    single = whole.argmax(axis=1)
    counts = w.counts[docs]
    # windows of LEAST words that another language explains better, for changes inside a sentence
    k = score.shape[1]
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(score, axis=0, dtype=np.float64)])
    begin = w.first[:-1][docs]
    # gain of each unit over the document's single language
    rel = unit - np.repeat(np.take_along_axis(unit, np.repeat(single, np.diff(np.append(doc_first, len(unit))))[:, None], 1), k, axis=1)
    gain = np.add.reduceat(np.maximum(rel, 0), doc_first, axis=0)
    window = np.zeros((len(docs), k))
    if len(score) >= LEAST:
        run = sums[LEAST:] - sums[:-LEAST]
        own = np.repeat(single, counts)[: len(run)]
        run = run - np.take_along_axis(run, own[:, None], 1)
        inside = np.repeat(begin + counts, counts)[: len(run)] - np.arange(len(run)) >= LEAST
        run[~inside] = 0
        starts = np.minimum(begin, len(run) - 1)
        window = np.maximum.reduceat(run, starts, axis=0)
    for d in range(len(docs)):
        a, m = int(begin[d]), int(counts[d])
        best = int(single[d])
        # candidates by EM proportion, or by a window for changes within a sentence
        more = [j for j in range(k) if j != best and (p[d, j] * m >= LEAST - 2 and gain[d, j] > PENALTY or window[d, j] > PENALTY)] if m >= 2 * LEAST else []
        parts = [(0, m, best)]
        if more:
            part = score[a : a + m]
            parts = _parts(language_set(part, opens[a : a + m], best, more), part)
        for s, e, j in parts:
            total = sums[a + e] - sums[a + s]
            margin = (total - total[j]) / np.sqrt(e - s)
            out[docs[d]].append((s, e, j, float(1 / np.exp(np.minimum(margin, 50)).sum())))
    return out


def _segments(batches: Iterator[pa.RecordBatch], model: TrigramModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows: list[list] = [[] for _ in range(8)]
        for s in W.chunks([texts]):
            for i, parts in enumerate(document_parts(model, W.words(texts[s])), s.start):
                stated = label_language(labels[i])
                for no, (a, b, j, sure) in enumerate(parts, 1):
                    for column, value in zip(rows, (i, no, LANGS[j], sure, a, b, stated, len(parts)), strict=True):
                        column.append(value)
        kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        yield pa.record_batch(
            [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], kinds, strict=True))],
            ["id", "seg_no", "lang", "confidence", "first_word", "end_word", "stated", "parts"],
        )


def fit_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", bound: int = MAX_TRAIN) -> TrigramModel:
    """Fit on a hash sample of about ``bound`` documents with their whole texts."""
    spark_rows = documents.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = spark_rows.count()
    share = min(1.0, 0.9 * bound / max(1, n))
    picked = spark_rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else spark_rows
    rows = picked.select(text_col, label_col).limit(bound).collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def document_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: TrigramModel | None = None) -> DataFrame:
    """The parts of every document with language and confidence.

    Returns (``id_col``, seg_no, lang, confidence, first_word, end_word, stated, parts); stated is the language the label
    names or null.  Null texts and texts without a word have no part; a text under ``LEAST`` words is one part.  Null ids are
    kept apart by row only; extra columns are ignored; an empty table gives an empty result.
    """
    model = model or fit_languages(documents, id_col, text_col, label_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the input
    picked = documents.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("text is not null")
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, seg_no int, lang string, confidence double, first_word int, end_word int, stated string, parts int"
    return arrow_map(picked, lambda it: _segments(it, shared.value), schema).withColumnRenamed("id", id_col)


def mislabelled(parts: DataFrame) -> DataFrame:
    """The parts of documents in several languages, and of those whose label is missing, unusable or wrong."""
    return parts.where((F.col("parts") > 1) | F.col("stated").isNull() | (F.col("stated") != F.col("lang")))
