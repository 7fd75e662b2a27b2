"""Text expressions: the tokeniser, stop words, renderings and categories.  Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words (all Unicode spaces), as a Java and as an RE2 class.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SPACE_RE2 = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: The English stop words.
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by"
    " can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has"
    " hasn hasn't have haven haven't having he her here hers herself him himself his how i if in into is isn isn't it it's its itself just"
    " ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours"
    " ourselves out over own re s same shan shan't she she's should should've shouldn shouldn't so some such t than that that'll the their"
    " theirs them themselves then there these they this those through to too under until up ve very was wasn wasn't we were weren weren't"
    " what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself"
    " yourselves"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """The words between white space; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), SPACE), lambda x: x != "")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def kept_tokens(text: Column | str) -> Column:
    """Tokens that are no stop words, whatever their case."""
    return F.filter(tokens(text), lambda x: ~F.lower(x).isin(*STOP_WORDS))


def without_stop_words(text: Column | str) -> Column:
    return F.concat_ws(" ", kept_tokens(text))


def render_sample(prompt: Column | str = "prompt", chosen: Column | str = "chosen", rejected: Column | str = "rejected") -> Column:
    """One string for a sample; two samples are the same if their strings are."""
    p, c, r = (F.coalesce(_col(x), F.lit("")) for x in (prompt, chosen, rejected))
    return F.concat(F.lit("Prompt: "), p, F.lit(", Chosen: "), c, F.lit(", Rejected: "), r)


def digest(text: Column | str) -> Column:
    """A fixed-width stand-in for a text in distinct counts, so that long texts aren't shuffled."""
    return F.unhex(F.sha2(F.coalesce(_col(text), F.lit("")), 256))


def category(prompt: Column | str = "prompt", mark: str = "r/relationships") -> Column:
    """``relationships`` if the prompt names that forum, else ``others``."""
    return F.when(F.lower(F.coalesce(_col(prompt), F.lit(""))).contains(mark), "relationships").otherwise("others")


def clean_dataset_name(name: Column | str) -> Column:
    """The last part of a path or repository name, up to its first dot."""
    return F.substring_index(F.substring_index(F.regexp_replace(_col(name), "/+$", ""), "/", -1), ".", 1)


def cache_key(query: Column | str, nonce: Column | str | None = None) -> Column:
    """SHA-256 of the query, with the nonce on a further line if there is one."""
    parts = [_col(query)] + ([_col(nonce)] if nonce is not None else [])
    return F.sha2(F.concat_ws("\n", *parts), 256)


def cache_index_name(name: str) -> str:
    """A cache table's name: lower case, slashes as underscores."""
    return name.lower().replace("/", "_")


def metric_key(dataset_idx: Column | str, key: Column | str) -> Column:
    return F.concat(F.lit("dataset-"), _col(dataset_idx).cast("string"), F.lit("/"), _col(key))
