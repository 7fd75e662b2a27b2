"""Problem 3: texts cut off by a field limit or in transfer.

Method: a stack automaton reads each whole text once and keeps what is open at its end (quotes,
brackets, fences, markup); the tail is then judged by structure: broken characters and escapes,
list items, signatures, closing marks, terminators.  A mark left open behind a finished sentence and a missing
terminator count as cuts unless the text's source has the habit of them (its own rate over all its texts).  Tails that
structure cannot decide (an ellipsis, a list item, a text in a style without any terminator) are judged by baselines
over all texts: how often a word ends a sentence, whether it is only the beginning of a frequent word, whether sentences that
begin like a closing phrase mostly stop there, and the length limits each source shows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.session import arrow_map, cut, small

#: Marks that end a sentence, and pairs of opening and closing marks.
TERMINATORS = ".?!。？！؟"
CLOSERS = {")": "(", "]": "[", "}": "{", "»": "«", "«": "»", "”": "“„", "“": "„"}
#: Elements that need no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd option tr td th thead tbody tfoot colgroup".split())
#: Names of which a text's last characters may be the beginning, after an ampersand.
ENTITIES = "amp lt gt quot apos nbsp mdash ndash hellip copy reg trade euro laquo raquo ldquo rdquo lsquo rsquo bdquo sbquo middot bull eacute egrave ecirc euml agrave aacute acirc atilde auml aring ccedil iacute igrave icirc ntilde oacute ograve ocirc otilde ouml uacute ugrave ucirc uuml szlig".split()
#: Texts that stand for no answer.
PLACEHOLDERS = frozenset(
    "n/a na nil null none nan undefined unknown empty blank missing todo tbd tba void -"
    " [no response] no response no answer not available not applicable no content no output".split()
    + ["no response", "no answer", "not available", "not applicable", "no content", "no output", "[no response]"]
)
#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = frozenset("cf mr mrs ms dr prof st vs viz approx bzw z.b u.a d.h ca e.g i.e p.ex bijv sr sra dhr mevr т.е т.к".split())

_TRAIL = " \t\r\n\v\f\u00a0\u200b\u200c\u200d\u2060\ufeff"
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>|<!--|-->")
_MARKS = re.compile(r"```|[<()\[\]{}«»„“”\"\n.?!]")
_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|[a-zA-Z][.)])(?:\s+|$)")
_SIGNED = re.compile(r"^\s*[—–-]{1,2}\s*[^\W\d_][\w.'’-]*(?:\s[^\W\d_][\w.'’-]*){0,3}\s*$")
_LABEL = re.compile(r"^\s*[^\W\d_]+(?:\s[^\W\d_]+)?\s*:$")
_CODE = re.compile(r"^(?: {4}|\t)\S")
#: A broken escape, reference, percent code or tag.  A bare percent sign follows a number in a finished text, a name like R&D or AT&T is no
#: reference, and a backslash may end a path.
_ESCAPE = re.compile(
    r"(?:\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<![A-Z])&(?:" + "|".join(sorted({e[:k] for e in ENTITIES for k in range(1, len(e) + 1)}, key=len, reverse=True)) + r")|&#[xX]?[0-9a-fA-F]{0,6}"
    r"|(?:(?<![\d\s])|(?<=%[0-9A-Fa-f]{2}))%[0-9A-Fa-f]?|%[A-Fa-f]|<[/A-Za-z][^<>]{0,60})$"
)
_FACE = re.compile(r"(?:^|(?<=\s))[:;=][-']?$")
_PATH = re.compile(r"(?:^|[\s\"'(])(?:[A-Za-z]:|\\\\)[^\s\"']*$")
_WORD = re.compile(r"[^\W_]+")
_EMPTYTAGS = re.compile(r"<[^<>]*>|&nbsp;")

COMPLETE, CUT, ASK_WORD, ASK_ITEM, ASK_ELLIPSIS, ASK_OPEN, ASK_BARE = range(7)
#: Characters a sentence may have on average in a text that is written in sentences at all.
STYLE = 600


def is_empty(text: str | None) -> bool:
    """Null, or without anything that could be an answer."""
    if text is None:
        return True
    if len(text) > 60:
        return not _WORD.search(_EMPTYTAGS.sub(" ", text))
    bare = _EMPTYTAGS.sub(" ", text).strip(_TRAIL + "\"'`").lower()
    return not _WORD.search(bare) or bare.strip("[](){}<>.:;,!?*-_ ") in PLACEHOLDERS or bare in PLACEHOLDERS


def open_marks(text: str) -> tuple[list[tuple[str, int]], int]:
    """What is open at the end, with places, and the place of the last terminator inside the text."""
    stack: list[tuple[str, int]] = []
    last = -1
    fence = False
    for m in _MARKS.finditer(text):
        c, i = m.group(), m.start()
        if c == "```":
            if fence:
                while stack and stack[-1][0] != "```":
                    stack.pop()
                if stack:
                    stack.pop()
            else:
                stack.append((c, i))
            fence = not fence
        elif fence:
            continue
        elif c in ".?!":
            last = i
        elif c == "\n":
            continue
        elif c == "<":
            tag = _TAG.match(text, i)
            if tag and tag.group(2) and not tag.group(3) and tag.group(2).lower() not in VOID:
                if not tag.group(1):
                    stack.append(("<", i))
                else:  # a closing tag closes the nearest element, whatever its name
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "<":
                            del stack[k:]
                            break
        elif c == '"':
            again = text[max(0, i - 2) : i] == "\n\n" and text[i + 1 : i + 2].strip()  # a quotation reopens in its next paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == '"':
                    del stack[k:]
                    if again:
                        stack.append((c, i))
                    break
            else:
                if not (i and text[i - 1].isdigit()):  # inches and seconds
                    stack.append((c, i))
        elif c in "([{„":
            if not (c == "(" and _FACE.search(text, max(0, i - 3), i)):
                stack.append((c, i))
        else:
            want = CLOSERS[c]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in want:
                    del stack[k:]
                    break
            else:
                if c in "«»“":  # opens or closes, by custom
                    stack.append((c, i))
    return stack, last


def last_word(s: str) -> str:
    """The last run of letters or digits, in lower case."""
    end = len(s)
    while end and not s[end - 1].isalnum():
        end -= 1
    start = end
    while start and s[start - 1].isalnum():
        start -= 1
    return s[start:end].lower()


def hanging(s: str, stack: list[tuple[str, int]]) -> bool:
    """Whether a bracket or an element is open, or a quotation begun in the last paragraph (longer ones may reopen in each)."""
    paragraph = s.rfind("\n\n")
    return any(m in "([{<" or i > paragraph for m, i in stack)


def _symbols(s: str) -> str:
    """Drop emoji and other symbols from the end."""
    i = len(s)
    while i and (s[i - 1] in _TRAIL or s[i - 1] in "\ufe0f\u200d" or ord(s[i - 1]) > 0x2190 and not s[i - 1].isalnum() and s[i - 1] not in "\ufffd。？！…"):
        i -= 1
    return s[:i]


def verdict(text: str | None) -> tuple[int, str, str, int]:
    """(verdict, last word, closing phrase, where it starts) of one text; all but the first only where baselines must decide."""
    if is_empty(text):
        return COMPLETE, "", "", 0
    assert text is not None
    s = text.rstrip(_TRAIL)
    # no escape is longer than 80 characters
    if s.endswith("\ufffd") or _ESCAPE.search(s[-80:]) or s.endswith("\\") and not _PATH.search(s[s.rfind("\n") + 1 :]):
        return CUT, "", "", 0
    stack, _ = open_marks(s)
    if any(m == "```" for m, _ in stack):
        return CUT, "", "", 0
    line = s[s.rfind("\n") + 1 :]
    if any(m == "<" and i >= len(s) - len(line) for m, i in stack):
        return CUT, "", "", 0
    last = last_word(s)
    if "\n" in s:
        if _ITEM.match(line):
            rest = line[_ITEM.match(line).end() :]
            if not _WORD.search(rest):
                return CUT, "", "", 0
            if rest[-1] not in TERMINATORS and len(_WORD.findall(rest)) <= 12:
                return ASK_ITEM, last, "", 0
        elif _SIGNED.match(line) and line.lstrip()[0] in "—–-" or line.startswith("```") or _CODE.match(line) or _LABEL.match(line):
            return COMPLETE, "", "", 0
    if s.endswith("```") or re.search(r"</[A-Za-z][\w-]*>$", s):
        return COMPLETE, "", "", 0
    bare = _symbols(s)
    symbols = len(bare) < len(s) and not s.endswith("…")
    bare = bare.rstrip("\"'’”»)]}*_`" + _TRAIL)
    if not bare:
        return COMPLETE, "", "", 0
    if bare.endswith(("...", "…", "..")):
        body = bare.rstrip(".… ")
        edge = max(body.rfind(c) for c in TERMINATORS + "\n")
        phrase = re.sub(r"\W+", " ", body[edge + 1 :]).strip().lower()
        return ASK_ELLIPSIS, last, phrase, edge + 1
    if bare[-1] in TERMINATORS:
        tail = bare[:-1].rsplit(None, 1)[-1].lower() if bare[:-1].strip() else ""
        if bare[-1] == "." and tail in ABBREVIATIONS:
            return CUT, "", "", 0
        return (ASK_OPEN if hanging(s, stack) else COMPLETE), last, "", 0
    # no terminator: the text's own style decides whether it should have one
    n = len(s)
    ends = len(re.findall(r"[.?!。](?=[\s\"'»”)]|$)", bare))
    if symbols and not ends:
        return ASK_WORD, last, "", 0
    if ends == 0 or n / (ends + 1) > STYLE:
        return ASK_WORD, last, "", 0
    return ASK_BARE, last, "", 0


_SCHEMA = "id {}, source string, field string, verdict int, word string, phrase string, before long, n_chars int, n_bytes int"


def _scan(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(id, source, fields) to one row for each field that isn't complete by structure."""
    for batch in batches:
        ids, sources = batch.column(0), batch.column(1)
        out: list[list] = [[] for _ in range(8)]
        at = []
        for f, name in enumerate(fields):
            for i, text in enumerate(batch.column(f + 2).to_pylist()):
                v, word, phrase, start = verdict(text)
                if v == COMPLETE:
                    continue
                at.append(i)
                # what stands before a closing phrase tells copies of one text from different texts
                before = zlib.crc32(text[max(0, start - 60) : start].encode("utf-8", "replace")) if v == ASK_ELLIPSIS else 0
                for column, value in zip(out, (name, v, word, phrase, before, len(text), len(text.encode("utf-8", "replace"))), strict=False):
                    column.append(value)
        take = pa.array(at, pa.int64())
        yield pa.record_batch(
            [ids.take(take), sources.take(take), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.int32())],
            ["id", "source", "field", "verdict", "word", "phrase", "before", "n_chars", "n_bytes"],
        )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, occurrences, occurrences that end a sentence, a line or the text)."""
    stop = np.zeros(0x110000, np.int8)
    stop[[ord(c) for c in TERMINATORS + "\n"]] = 1
    held: dict[int, list] = {}

    def add(w: W.Words) -> None:
        if not len(w.hashes):
            return
        chars = np.frombuffer(w.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        final = stop[chars[np.minimum(w.end, len(chars) - 1)]]
        u, at, inverse, n = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
        f = np.bincount(inverse, weights=final, minlength=len(u)).astype(np.int64)
        for h, i, k, e in zip(u.tolist(), at.tolist(), n.tolist(), f.tolist(), strict=True):
            if h in held:
                held[h][1] += k
                held[h][2] += e
            else:
                held[h] = [w.text[w.start[i] : w.end[i]], k, e]

    def out() -> pa.RecordBatch:
        rows = list(held.values())
        held.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["word", "n", "ends"])

    for batch in batches:
        texts = [t for c in batch.columns for t in c.to_pylist()]
        for s in W.chunks([texts]):
            add(W.words(texts[s]))
        if len(held) > 300_000:
            yield out()
    if held:
        yield out()


def _sentences(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each sentence, its number of words, and whether it is the last of its text."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    stop = np.zeros(0x110000, np.int8)
    stop[[ord(c) for c in TERMINATORS + "\n…"]] = 1  # texts of a chunk are parted by line breaks
    chars = np.frombuffer(w.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.cumsum(stop[chars], dtype=np.int32)
    opens = np.ones(n, bool)
    opens[1:] = stops[w.start[1:]] > stops[w.end[:-1] - 1]
    first = np.flatnonzero(opens)
    return first, np.diff(np.append(first, n)), np.isin(np.append(first[1:], n), w.first[1:])


def _openings(w: W.Words, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the words of sentences up to, not with, the last of ``length`` words."""
    key = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length - 1):
            key = W.mix(key * np.uint64(3) + w.hashes[first + k])
    return key


def _count_openings(batches: Iterator[pa.RecordBatch], lengths: list[int], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts to (words, key, word, sentences that begin so, those of them that stop there as the end of the text).

    Keys without a mark are left out; no phrase has one of them.
    """
    for batch in batches:
        texts = [t for c in batch.columns for t in c.to_pylist()]
        for s in W.chunks([texts]):
            w = W.words(texts[s])
            first, size, final = _sentences(w)
            for length in lengths:
                long = np.flatnonzero(size >= length)
                key = _openings(w, first[long], length)
                some = marks[(key & np.uint64(len(marks) - 1)).astype(np.int64)]
                long, key = long[some], key[some]
                last = first[long] + length - 1
                with np.errstate(over="ignore"):
                    whole = W.mix(key * np.uint64(3) + w.hashes[last])
                _, at, inverse, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                closes = np.bincount(inverse, weights=final[long] & (size[long] == length), minlength=len(at)).astype(np.int64)
                words = [w.text[w.start[i] : w.end[i]] for i in last[at].tolist()]
                yield pa.record_batch(
                    [pa.array(np.full(len(at), length, np.int32)), pa.array(key[at].view(np.int64)), pa.array(words, pa.string()), pa.array(n.astype(np.int64)), pa.array(closes)],
                    ["words", "key", "word", "n", "closes"],
                )


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closing phrases to (phrase, words, key of all but the last, last word)."""
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for phrase in batch.column(0).to_pylist():
            w = W.words([phrase])
            if n := len(w.hashes):
                key = _openings(w, np.zeros(1, np.int64), n)
                out.append((phrase, n, int(key.view(np.int64)[0]), w.text[w.start[-1] : w.end[-1]]))
        yield pa.record_batch(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.string())],
            ["phrase", "words", "key", "last"],
        )


def _closing_phrases(rows: DataFrame, asked: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(phrase, closing): whether most sentences that begin with the characters of the phrase end their text there."""
    seen = asked.where(F.col("verdict") == ASK_ELLIPSIS).groupBy("phrase").agg(F.countDistinct("before").alias("texts"))
    phrases = cut(arrow_map(seen.where(F.col("texts") >= PHRASE_TEXTS).select("phrase"), _phrase_keys, "phrase string, words int, key long, last string"), "phrases")
    lengths = sorted(r[0] for r in phrases.select("words").distinct().collect())
    marks = np.zeros(MARKS, bool)  # of a fixed size; the join below decides
    marks[[r[0] for r in phrases.select(F.pmod("key", F.lit(MARKS)).cast("int")).distinct().collect()]] = True
    begun = arrow_map(rows.select(*fields), lambda it: _count_openings(it, lengths, marks), "words int, key long, word string, n long, closes long")
    begun = begun.join(small(phrases, 120), ["words", "key"]).where(F.col("word").startswith(F.col("last")))
    stops = F.sum(F.when(F.col("word") == F.col("last"), F.col("closes")).otherwise(0))
    return begun.groupBy("phrase").agg((stops >= F.sum("n") * F.lit(CLOSING)).alias("closing"))


#: A word seen at least DANGLING_SEEN times of which a share under DANGLING ends something does not end a text.
DANGLING_SEEN, DANGLING = 30, 0.01
#: A word seen at most FRAGMENT_SEEN times that begins a word seen PREFIX_SEEN times or more is a fragment.
FRAGMENT_SEEN, PREFIX_SEEN = 3, 20
#: A closing phrase follows at least PHRASE_TEXTS different texts, and of all sentences that begin with its characters a share of CLOSING or
#: more end their text there; a cut is one of many sentences that go on elsewhere, however often it falls on the same place.
PHRASE_TEXTS, CLOSING = 3, 0.5
#: Marks by which sentences that begin like no closing phrase are passed over; a power of two.
MARKS = 1 << 18
#: Shares of a source's texts (with EVIDENCE texts without them added) above which a missing terminator, and a mark left open behind a
#: finished sentence, are the source's habit and no sign of a cut.
HABIT_BARE, HABIT_OPEN, EVIDENCE = 0.5, 0.02, 200
#: Beginnings of words up to this length are listed; longer ones are compared with each other.
LISTED = 200
#: A length at which this many texts of a source and field are surely cut is a limit of that source.
LIMIT_CUTS = 5


def truncated_fields(
    rows: DataFrame, id_col: str = "sample_id", source_col: str = "source", fields: tuple[str, ...] = ("prompt", "chosen", "rejected")
) -> DataFrame:
    """The fields whose text stops within a word or sentence.

    Returns (``id_col``, source, field, n_chars, n_bytes), one row for each cut field.  Repeated ids count once; null,
    empty and placeholder texts are no cut; a null source is kept as null; null ids are dropped; an empty table gives an
    empty result.
    """
    rows = rows.where(F.col(id_col).isNotNull())
    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *fields)
    # (id, field) once: deliveries of one id have the same content
    scanned = arrow_map(picked, lambda it: _scan(it, fields), _SCHEMA.format(kind)).dropDuplicates(["id", "field"])
    scanned = cut(scanned, "tails")
    sure = scanned.where(F.col("verdict").isin(CUT, ASK_BARE))
    asked = scanned.where(F.col("verdict") != CUT)

    phrases = _closing_phrases(rows, asked, fields)
    words = arrow_map(rows.select(*fields), _count_words, "word string, n long, ends long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    words = cut(words, "vocabulary")
    wanted = asked.select("word").distinct()
    known = words.join(wanted, "word")
    frequent = words.where(F.col("n") >= PREFIX_SEEN)
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(LISTED))), lambda k: F.col("word").substr(F.lit(1), k))
    starts = frequent.where(F.length("word") > 1).select(F.explode(heads).alias("word")).distinct().join(wanted, "word")
    head = F.substring("word", 1, LISTED).alias("head")
    long = wanted.where(F.length("word") > LISTED).select("word", head).join(frequent.where(F.length("word") > LISTED + 1).select(F.col("word").alias("whole"), head), "head")
    long = long.where((F.length("whole") > F.length("word")) & F.col("whole").startswith(F.col("word"))).select("word").distinct()
    starts = starts.union(long).withColumn("begins", F.lit(True))
    # a limit is a length at which a source's texts are often cut and which none exceeds
    sizes = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.length(f).alias("n_chars"), F.octet_length(f).alias("n_bytes")) for f in fields)))
    greatest = rows.select(F.col(source_col).cast("string").alias("source"), sizes.alias("z")).groupBy("source", F.col("z.field").alias("field"))
    greatest = cut(greatest.agg(F.max("z.n_chars").alias("n_chars"), F.max("z.n_bytes").alias("n_bytes"), F.count("z.n_chars").alias("texts")), "greatest")
    # habits: one row a source and field
    signs = scanned.groupBy("source", "field").agg(*(F.sum((F.col("verdict") == v).cast("int")).alias(name) for name, v in (("bare", ASK_BARE), ("open", ASK_OPEN))))
    signs = signs.alias("s").join(greatest.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.field") == F.col("g.field")))
    share = lambda c: F.col(c) / (F.col("texts") + F.lit(EVIDENCE))
    signs = signs.select(F.col("s.source").alias("s"), F.col("s.field").alias("f"), (share("bare") > HABIT_BARE).alias("bare_habit"), (share("open") > HABIT_OPEN).alias("open_habit"))
    limit = [
        sure.groupBy("source", "field", F.col(size).alias("size")).agg(F.count("*").alias("cuts")).where(F.col("cuts") >= LIMIT_CUTS).alias("c")
        .join(greatest.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.field") == F.col("g.field")) & (F.col("size") >= F.col(f"g.{size}") - slack))
        .select("c.source", "c.field", F.col("size").alias(size), F.lit(True).alias(f"at_{size}"))
        for size, slack in (("n_chars", 0), ("n_bytes", 3))  # a limit in bytes may spare a broken character
    ]
    asked = asked.join(signs, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left").drop("s", "f")
    judged = asked.join(known, "word", "left").join(starts, "word", "left").join(phrases, "phrase", "left")
    for side, size in zip(limit, ("n_chars", "n_bytes"), strict=True):
        side = side.withColumnRenamed("source", "s").withColumnRenamed("field", "f").withColumnRenamed(size, "z")
        judged = judged.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col(size) == F.col("z")), "left").drop("s", "f", "z")
    fragment = (F.coalesce("n", F.lit(0)) <= FRAGMENT_SEEN) & F.coalesce("begins", F.lit(False))
    dangling = (F.col("n") >= DANGLING_SEEN) & (F.col("ends") < F.col("n") * F.lit(DANGLING))
    at_limit = F.coalesce("at_n_chars", F.lit(False)) | F.coalesce("at_n_bytes", F.lit(False))
    is_cut = (
        F.when(F.col("verdict") == ASK_ELLIPSIS, ~F.coalesce("closing", F.lit(False)) | at_limit)
        .when(F.col("verdict") == ASK_ITEM, fragment | at_limit)
        .when(F.col("verdict") == ASK_OPEN, ~F.col("open_habit") | at_limit)
        .when((F.col("verdict") == ASK_BARE) & ~F.col("bare_habit"), True)
        .otherwise(fragment | F.coalesce(dangling, F.lit(False)) | at_limit)
    )
    keep = ["id", "source", "field", "n_chars", "n_bytes"]
    return scanned.where(F.col("verdict") == CUT).select(*keep).union(judged.where(is_cut).select(*keep)).withColumnRenamed("id", id_col)


def truncation_report(rows: DataFrame, cut_fields: DataFrame, id_col: str = "sample_id", source_col: str = "source", fields: tuple[str, ...] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """Per source and field: texts, cut texts, their share, and the commonest length of cut ones.

    A null source is a source of its own; null texts aren't counted.
    """
    one = rows.dropDuplicates([id_col]).select(F.col(source_col).cast("string").alias("source"), *fields)
    totals = one.groupBy("source").agg(*(F.count(f).alias(f) for f in fields)).unpivot("source", list(fields), "field", "texts")
    cuts = cut_fields.groupBy("source", "field").agg(F.count("*").alias("cut_texts"), F.mode("n_chars", True).alias("usual_length"))
    cuts = cuts.withColumnRenamed("source", "s").withColumnRenamed("field", "f")
    joined = totals.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left").drop("s", "f")
    return joined.select("source", "field", "texts", F.coalesce("cut_texts", F.lit(0)).alias("cut_texts"), F.round(F.coalesce("cut_texts", F.lit(0)) / F.greatest("texts", F.lit(1)), 6).alias("share"), "usual_length")
