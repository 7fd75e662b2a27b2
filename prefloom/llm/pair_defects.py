"""Problem 5: prompt and response pairs whose response is no proper answer.

Method: a suffix automaton of the prompt's words is traversed by the response and gives the
share of the response that is copied; refusal automata, the delimiter stack of problem 3 and
votes of function words find the other defects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.llm._lang import FUNCTION_WORDS, LANGUAGE_NAMES, text_votes, word_bits
from prefloom.llm.truncation import is_empty, truncated_fields
from prefloom.session import arrow_map

#: A copy holds this share of its own words and of the prompt's words in copied runs of RUN words or more.
COPIED, RETURNED, RUN = 0.7, 0.5, 3
#: Share of the response's word pairs below which no such coverage by runs of RUN words is possible, so the automaton isn't built.
POSSIBLE = 0.4
#: Of a response's function words a share of OWN, and VOTES of them, must be words of its own language, and at most a share of LEFT may be
#: words of the prompt's language and not of its own.  A word that both have (a, do, as) speaks for neither.
OWN, VOTES, LEFT = 0.6, 3.0, 0.15
#: A refusal's words outside refusal phrases: at most this share, or any in a text of at most BRIEF words.
AROUND, BRIEF = 0.3, 30
#: Share of an English refusal's words that are neither function words nor words about asking and answering.
CONTENT = 0.2

#: The English refusal automaton: a negation, a few linking words, an act of answering.  Fixed values, by class.
_NEGATION = (
    r"(?:can|could|will|would|do|does|did|must|may|might|shall|should|am|are|is|was|m|re|s|be|have|has|had) not|(?:can|couldn|won|wouldn|don|doesn|didn|mustn|shouldn|isn|aren|wasn|haven|hasn) t"
    r"|cannot|cant|wont|dont|never|unable|refus\w+|declin\w+|forbidden|forbids?|prohibit\w*|prevents?|barred|not"
)
_LINK = (
    r"able|about|a|allow|allowed|an|and|any|anything|appropriate|asked|at|authori[sz]ed|be|been|being|can|comfortable|could|currently|designed|doing|even|ever|feel|for|free|from|further|get|give|giving|going|good|conscience|is|one|part|possible"
    r"|happy|here|honestly|i|in|inclined|into|it|know|let|liberty|like|make|me|meant|more|my|of|offer|on|open|or|permitted|position|possibly|prepared|provide|ready|really|right|should"
    r"|simply|supposed|taking|that|the|think|this|to|truly|try|us|want|we|willing|wish|with|would|you|your"
)
_ACT = (
    r"help\w*|assist\w*|answer\w*|respon\w+|repl(?:y|ies|ied|ying)|discuss\w*|comment\w*|talk\w*|speak\w*|writ\w+|provid\w+|shar\w+|compl(?:y|ied|ying)|fulfil\w*|engag\w+|say|tell|address\w*|handl\w+|advi[sc]\w+"
    r"|explain\w*|continu\w+|contribut\w+|participat\w+|proceed\w*|do|weigh|touch|entertain|oblige|opinion\w*|elaborate|statement|go|request\w*|information|guidance|input"
)
_IMPERSONAL = (
    r"no comment|no answer (?:from|will|can|is)|off limits|out of bounds|off the table|nothing (?:to say|to add|i can say|more to say)|(?:beyond|outside)(?: of)? (?:what (?:i|we)|my|our|the scope)"
    r"|(?:inappropriate|improper|wrong|unethical|irresponsible)(?: of| for| if)? (?:me|us|i|we)\b|against (?:my|our|the) (?:guidelines|policy|policies|rules|principles|instructions)"
    r"|\bi (?:must |have to |will |would |respectfully |politely |need to |going to |am |m |shall |ll |d )*(?:decline|refuse|pass|abstain|refrain)\b|not possible for (?:me|us)|not (?:something|a (?:topic|subject|question|matter|request)|one) (?:that )?(?:i|we)\b"
    r"|(?:rather|prefer) not|keep (?:silent|quiet|out)|stay (?:silent|quiet|out)|(?:my|our) (?:guidelines|rules|instructions|policies|policy) (?:do not|don t|forbids?|prevents?|prohibits?)|do not feel comfortable|don t feel comfortable|(?:will|must) be (?:left )?unanswered|talk about something (?:different|else)"
)
_REFUSE_EN = re.compile(rf"\b(?:(?:{_NEGATION})(?: (?:{_LINK})){{0,7}} (?:{_ACT})|{_IMPERSONAL})\b")
_SELF = re.compile(r"\b(?:i|we|me|my|us|our|this (?:assistant|service|system|model))\b|^no comment")
#: Words about asking, answering and declining; with the function words they make up nearly all of a refusal.
_ABOUT = frozenset(
    "able abstain add barred conscience designed giving handle taking address advice advise afraid against ai allow allowed alternative am answer answered answering answers any anything apologies apologise apologize appropriate area are aren ask asked asking assist assistance"
    " assistant authorised authorized aware beyond bounds can cannot comfortable comment complete comply consider consult contact content continue contribute convey couldn decline declining different difficult discuss discussing"
    " discussion do doesn don done elaborate else engage entertain ethical expert explain feel fine find forgive free fulfil fulfill further give glad go going good guidance guidelines happy harmful have haven help helped"
    " helpful helping here honest honestly hope how i idea inappropriate inclined information input instead instructions interest issue keep kind kindly know language least let liberty like limits m matter may me mean might model"
    " more must my need never nothing off offer once opinion our outside part participate pass perhaps permission permitted please point policies policy position possible practice prefer prepared privacy private proceed professional"
    " prohibited prompt proper provide question questions quiet rather ready really reason reasons refrain refuse refusing regret related rephrase replies reply request requests respect respectfully respond responding response"
    " responses right rule rules safe safety say scope seek sensitive sensible service share should silent silence simply since something sorry sort speak specialist statement stay subject suggest support sure system t talk"
    " talking tell thank thanks the thing things think this to today topic topics touch truly try turn unable unanswered understand understanding unfortunately us want was wasn we weigh willing wish won word words work would wouldn write"
    " writing wrong yes you your".split()
) | frozenset(FUNCTION_WORDS["en"].split())
_TRIGGERS = frozenset(
    "not t cannot cant wont dont never unable refuse refusing decline declining forbidden forbids prohibited prohibits prevent prevents barred comment limits bounds table nothing beyond outside inappropriate improper wrong unethical irresponsible against pass abstain refrain keep stay unanswered no something".split()
)

#: Refusing cores and courteous surroundings, as patterns over lower-cased words joined by one space.
_CORES = (
    r"(?:can ?t|cannot|can not|could not|couldn t|won t|will not|must not|may not|am unable to|m unable to|am not able to|m not able to|not able to|unable to) (?:be )?(?:help|assist|answer|comply|provide|providing|respond|reply|discuss|fulfil+|complete|engage|support|do that|write|continue|give|share|talk)(?:\w*)",
    r"(?:must|have to|need to|will|would) (?:respectfully |politely )?(?:decline|refuse)",
    r"(?:do not|don t) feel comfortable",
    r"(?:would )?rather not (?:respond|answer|discuss|say|talk|write)",
    r"(?:have no|not have|do not have|don t have) (?:the )?permission",
    r"no answer will be given",
    r"(?:do not|don t|does not|not) allow(?:ed)? (?:me |a |any )?(?:to )?(?:reply|answer|respond|discuss|write)",
    r"not something (?:that )?(?:can|i can|we can) be discussed|not something (?:that )?i can",
    r"falls? outside (?:of )?what",
    r"against my guidelines|not permitted to|not allowed to",
    r"kann ich (?:leider )?nicht (?:beantworten|helfen)|kann ich (?:dir|ihnen) (?:leider )?nicht|dabei kann ich leider nicht helfen|keine auskunft geben|darf ich (?:leider )?nicht|möchte ich (?:lieber )?nicht (?:beantworten|antworten)|nicht beantworten",
    r"ne peux pas (?:vous |t )?(?:aider|répondre)|impossible de (?:traiter|répondre|vous aider)|préfère ne pas répondre|ne suis pas (?:en mesure|autorisée?)|refuse de répondre|pas autorisée? à",
    r"no puedo (?:ayudar\w*|responder|contestar|hablar|atender)|prefiero no (?:responder|contestar|hablar)|no me está permitido|no estoy autorizad[oa]|no se me permite",
    r"(?:daar )?kan ik je (?:helaas )?niet mee helpen|mag over dit onderwerp|liever geen antwoord|kan ik (?:helaas )?niet (?:beantwoorden|helpen|mee helpen)|mag ik (?:helaas )?niet|helaas niets zeggen",
    r"não posso (?:ajudar|responder|falar|atender)|prefiro não responder|não me é permitido|não estou autorizad[oa]|não tenho permissão",
    r"(?:помочь )?не могу|мне нельзя|предпочитаю не отвечать|не буду отвечать|не имею права|помочь не могу|не вправе",
)
_COURTESY = (
    r"(?:i am |i m |we are )?(?:very |so |really )?sorry(?: but| about that)?|apologies(?: but)?|unfortunately|i regret(?: to say)?(?: that)?|thank you(?: very much)? for (?:asking|your \w+)(?: but)?|as an? (?:ai )?(?:assistant|language model|model)|i have to be honest(?: here)?",
    r"with (?:that|this|it)(?: request| topic| question)?|(?:this|the|your|that) (?:request|question|topic|matter|subject)|to questions of this kind|at (?:this|the) (?:time|moment)|because the matter is too sensitive|as it goes against my guidelines|an answer here|about that|to write|on this",
    r"please (?:ask|consult|contact) (?:a|an|your) [\w ]{0,40}?(?:person|expert|professional|doctor|lawyer|specialist)(?: instead)?|you may want to rephrase your question|is there (?:something|anything) else you would like to talk about|try another topic|let us talk about something (?:different|else)(?: instead)?|hope this helps|i hope that is clear|what this service may answer|my instructions",
    r"es tut mir leid(?: aber)?|leider|bitte wenden sie sich an eine fachperson|diese frage|zu diesem thema|ich möchte|dabei",
    r"je suis désolée?(?: mais)?|désolée?|il m est|cette (?:demande|question)|sur ce point|je|vous",
    r"lo siento(?: pero)?|con eso|de ese asunto|a esta pregunta|hablar",
    r"het spijt me(?: maar)?|op deze vraag|geef ik|daar",
    r"lamento(?: mas)?|desculp\w+|com isso|a esta pergunta|sobre esse assunto|falar",
    r"к сожалению|извините(?: но)?|на этот вопрос|эту тему|обсуждать|с этим|я",
)
#: Words of which every core has at least one.
_CORE_WORDS = frozenset(
    "t not cannot unable decline refuse rather permission no falls fall against nicht keine pas impossible préfère refuse puedo prefiero niet liever mag niets não prefiro не нельзя предпочитаю".split()
)
_CORE = re.compile(r"\b(?:" + "|".join(_CORES) + r")\b")
_AROUND = re.compile(r"\b(?:" + "|".join(_CORES + _COURTESY) + r")\b")
_WORD = re.compile(r"[^\W_]+")
#: A refusing phrase that only reports what somebody said, or an answer that follows it.
_QUOTED = re.compile(r"[\"“«][^\"”»\n]{0,120}[\"”»]")


def is_refusal(text: str) -> bool:
    """Declines and gives no answer: little stands beside the refusing phrases."""
    words = _WORD.findall(_QUOTED.sub(" ", text).lower())
    flat = " ".join(words)
    total = len(_WORD.findall(text))
    if not _TRIGGERS.isdisjoint(words) and sum(x not in _ABOUT for x in words) + total - len(words) <= CONTENT * total and _SELF.search(flat) and _REFUSE_EN.search(flat):
        return True
    if _CORE_WORDS.isdisjoint(words) or not _CORE.search(flat):
        return False
    outside = len(_WORD.findall(_AROUND.sub(" ", flat))) + total - len(flat.split())
    return outside <= AROUND * total or total <= BRIEF and outside <= 0.75 * total


class SuffixAutomaton:
    """All runs of a sequence; ``copied`` walks another sequence through it."""

    def __init__(self, sequence: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for place, item in enumerate(sequence):
            new = self._state(self.size[last] + 1, {}, 0, place)
            p = last
            while p >= 0 and item not in self.next[p]:
                self.next[p][item] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][item]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], self.end[q])
                    while p >= 0 and self.next[p].get(item) == q:
                        self.next[p][item] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, size: int, following: dict[int, int], link: int, end: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def copied(self, sequence: list[int], run: int) -> tuple[int, int]:
        """(items of ``sequence`` inside copied runs, items of the automaton's sequence they came from)."""
        state = length = 0
        mine: set[int] = set()
        theirs: set[int] = set()
        for place, item in enumerate(sequence):
            while state and item not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if item in self.next[state]:
                state = self.next[state][item]
                length += 1
            else:
                state = length = 0
            if length >= run:
                mine.update(range(place - run + 1, place + 1))
                # the first end of a state may lie elsewhere than a longer match, but covers an equal run
                theirs.update(range(self.end[state] - run + 1, self.end[state] + 1))
        return len(mine), len(theirs)


def is_copy(prompt: list[int], response: list[int]) -> bool:
    """The response gives only the prompt back, exactly or nearly."""
    if not prompt or not response:
        return False
    run = min(RUN, len(prompt), len(response))
    mine, theirs = SuffixAutomaton(prompt).copied(response, run)
    return mine >= COPIED * len(response) and theirs >= RETURNED * len(prompt)


def _inspect(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(id, prompt, responses) to (id, field, defect) for all defects but truncation."""
    n = len(fields)
    for batch in batches:
        ids = batch.column(0)
        columns = [batch.column(i + 1).to_pylist() for i in range(n + 1)]
        at: list[int] = []
        field: list[str] = []
        defect: list[str] = []

        def add(i: int, f: str, d: str) -> None:
            at.append(i)
            field.append(f)
            defect.append(d)

        for s in W.chunks(columns):
            texts = [c[s] for c in columns]
            base = s.start
            prompts = W.words(texts[0])
            pv = text_votes(prompts)
            named = text_votes(prompts, LANGUAGE_NAMES, "names")
            pp, pf = W.pairs_of(prompts)
            with np.errstate(over="ignore"):
                mark = lambda v, f: W.mix(v + np.repeat(np.arange(len(f) - 1), np.diff(f)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                pkeys = np.sort(mark(pp, pf))
            p_top = pv.argmax(axis=1)
            for name, own in zip(fields, texts[1:], strict=True):
                w = W.words(own)
                v = text_votes(w)
                top = v.argmax(axis=1)
                rows = np.arange(len(own))
                bits, owner = word_bits(w), w.owner()
                mine = bits[np.arange(len(owner)), top[owner]]
                count = lambda x, n=len(own), owner=owner: np.bincount(owner[x], minlength=n)
                alone, heard = count(bits[np.arange(len(owner)), p_top[owner]] & ~mine), count(bits.any(axis=1))
                foreign = (top != p_top) & (v[rows, top] >= VOTES) & (count(mine) >= OWN * heard) & (alone <= LEFT * heard) & (pv[rows, p_top] >= 2) & (pv[rows, p_top] >= 0.5 * pv.sum(axis=1)) & (named[rows, top] == 0)
                rp, rf = W.pairs_of(w)
                with np.errstate(over="ignore"):
                    rkeys = mark(rp, rf)
                if len(pkeys) and len(rkeys):
                    seen = pkeys[np.minimum(np.searchsorted(pkeys, rkeys), len(pkeys) - 1)] == rkeys
                    sums = np.concatenate(([0], np.cumsum(seen)))
                    shared = sums[rf[1:]] - sums[rf[:-1]]
                else:
                    shared = np.zeros(len(own), np.int64)
                pairs = np.diff(rf)
                for i, text in enumerate(own):
                    if is_empty(text):
                        add(base + i, name, "empty")
                        continue
                    if is_refusal(text):
                        add(base + i, name, "refusal")
                    if foreign[i]:
                        add(base + i, name, "language")
                    words = w.first[i + 1] - w.first[i]
                    asked = prompts.first[i + 1] - prompts.first[i]
                    # runs of a prompt under RUN words are shorter than the bound assumes
                    if words and asked and (asked < RUN or shared[i] >= POSSIBLE * pairs[i]):
                        a = prompts.hashes[prompts.first[i] : prompts.first[i + 1]].tolist()
                        b = w.hashes[w.first[i] : w.first[i + 1]].tolist()
                        if is_copy(a, b):
                            add(base + i, name, "copy")
        yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(defect, pa.string())], ["id", "field", "defect"])


def response_defects(rows: DataFrame, id_col: str, prompt: str, responses: tuple[str, ...]) -> DataFrame:
    """All defects but truncation; see ``pair_defects``."""
    rows = rows.where(F.col(id_col).isNotNull())
    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), prompt, *responses)
    found = arrow_map(picked, lambda it: _inspect(it, responses), f"id {kind}, field string, defect string")
    return found.dropDuplicates(["id", "field", "defect"]).withColumnRenamed("id", id_col)


def pair_defects(
    rows: DataFrame, id_col: str = "sample_id", prompt: str = "prompt", responses: tuple[str, ...] = ("chosen", "rejected"), source_col: str = "source", truncated: DataFrame | None = None
) -> DataFrame:
    """Defective responses: (``id_col``, field, defect).

    A response may have several defects; an empty one (null, blank, placeholder) has no other.  A null prompt counts as
    empty: it is copied by nothing and has no language.  Repeated ids count once, null ids are dropped, extra columns are
    ignored, an empty table gives an empty result.  ``truncated`` takes a result of ``truncated_fields`` that is at hand.
    """
    if truncated is None:
        truncated = truncated_fields(rows, id_col, source_col, (prompt, *responses))
    cut_off = truncated.where(F.col("field").isin(*responses)).select(id_col, "field", F.lit("truncated").alias("defect"))
    return response_defects(rows, id_col, prompt, responses).union(cut_off)
