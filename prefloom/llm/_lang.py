"""Function words of the corpus languages and vectorised votes."""

from __future__ import annotations

import numpy as np

from prefloom.llm import _words as W

LANGS = ("en", "de", "fr", "es", "nl", "pt", "ru")

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": "the and of to a in is it that was for on are with as his they be at one have this from or had by but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could my than been who its now did get come may part i you he not don am us our does once because while during throughout despite whenever upon rather merely whose both either neither nor such hence thus between",
    "de": "der die das und ist in zu den mit von für auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich können dieser seit während trotz weil immer doch viele warum damit bleibt deshalb erst danach kein keine ihr wir",
    "fr": "le la les de des du et est un une en que qui dans pour pas au aux avec sur se ne ce par plus son sa ses il elle nous vous ils mais ou où comme tout être été cette ces leur fait si sans même aussi après avant pendant parce quand depuis encore très chez entre pourquoi presque chaque puis moins trop alors fut je on d l qu n s j",
    "es": "el la los las de del y es un una en que por para con no se lo al su sus como más pero o este esta sí porque entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras está ya siendo casi cada luego después fue tan hacia",
    "nl": "de het een en van is in te dat die op voor met zijn er niet aan als ook bij om dan maar naar uit wordt of door over ze tot hij was heeft worden nog wel al geen meer zo deze hun werd wat kan waar hebben onder omdat toen zoals altijd veel tegen na tijdens wanneer waarom eerst daarna bijna mensen weten sinds enkele ondanks blijft ik je u daarom pas",
    "pt": "o a os as de do da dos das e é um uma em no na nos nas que por para com não se ao aos à mais como mas ou seu sua seus suas foi são pelo pela ele ela isso este esta quando muito já também só até sem entre depois antes durante porque cada quase ainda sobre tem há eu você lhe mesmo pouco onde apesar muitas pessoas sabem tão",
    "ru": "и в не на что он с как по но они мы она это за от из у же вы так к его для был то все бы было если уже или ни быть есть о до еще ещё когда этот только также после перед между очень потому почти каждый через при чем лишь потом во ко со под над без много люди хотя поэтому сначала затем чтобы который именно больше несмотря",
}

#: Names by which a text may ask for a language.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés ingles inglês engels английский английском английски",
    "de": "german deutsch deutsche allemand alemán aleman alemão duits немецкий немецком немецки",
    "fr": "french französisch français francais francés frances francês frans французский французском французски",
    "es": "spanish spanisch espagnol español espanol espanhol spaans испанский испанском испански",
    "nl": "dutch niederländisch holländisch néerlandais neerlandés holandés holandês neerlandês nederlands нидерландский голландский нидерландском",
    "pt": "portuguese portugiesisch portugais portugués português portugees португальский португальском португальски",
    "ru": "russian russisch russe ruso russo russisch русский русском русски",
}

_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(source: dict[str, str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and, for each, its share of a vote for every language."""
    if name not in _cache:
        votes: dict[int, np.ndarray] = {}
        for i, lang in enumerate(LANGS):
            for word in dict.fromkeys(source[lang].split()):
                votes.setdefault(W.word_hash(word), np.zeros(len(LANGS), np.float32))[i] = 1
        keys = np.array(sorted(votes), dtype=np.uint64)
        table = np.stack([votes[int(k)] for k in keys])
        _cache[name] = keys, table / table.sum(axis=1, keepdims=True)
    return _cache[name]


def word_votes(w: W.Words, source: dict[str, str] = FUNCTION_WORDS, name: str = "function") -> np.ndarray:
    """For each word the votes for each language (zero for words not in the list)."""
    keys, table = _lookup(source, name)
    at = np.minimum(np.searchsorted(keys, w.hashes), len(keys) - 1)
    return np.where((keys[at] == w.hashes)[:, None], table[at], np.float32(0))


def text_votes(w: W.Words, source: dict[str, str] = FUNCTION_WORDS, name: str = "function") -> np.ndarray:
    """For each text the votes for each language."""
    total = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(word_votes(w, source, name), axis=0, dtype=np.float64)])
    return total[w.first[1:]] - total[w.first[:-1]]


def word_bits(w: W.Words) -> np.ndarray:
    """For each word and language whether it is a function word there."""
    keys, table = _lookup(FUNCTION_WORDS, "function")
    at = np.minimum(np.searchsorted(keys, w.hashes), len(keys) - 1)
    return (keys[at] == w.hashes)[:, None] & (table[at] > 0)


def common_words() -> np.ndarray:
    """Sorted hashes of all function words."""
    return _lookup(FUNCTION_WORDS, "function")[0]
