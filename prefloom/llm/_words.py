"""Vectorised word hashing for Arrow batches.

A *word* is a run of letters or digits, lower-cased.  A batch of texts becomes flat numpy
arrays (one 64-bit hash for each word, offsets for each text), so that shingles, sketches and
dictionary look-ups are array passes and no Python loop runs over words.  Null counts as
an empty text.  Texts are cut into chunks of about 200,000 characters to stay in cache;
a chunk always holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def alnum() -> np.ndarray:
    """1 for each code point that is a letter or a digit."""
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=np.int8, count=0x110000)
    return _tables["alnum"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    have = _tables.get("powers")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _PRIME | 1
        with np.errstate(over="ignore"):
            for key, value in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                _tables[key] = np.cumprod(np.full(size, value, dtype=np.uint64))
    return _tables["powers"], _tables["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a list of texts: text i owns words ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray  # character offsets in ``text``
    end: np.ndarray
    text: str
    text_start: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: list[str | None]) -> Words:
    """Hash all words of ``texts`` in one go."""
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join(low) + "\n"
    if joined.isascii():
        chars = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
    else:
        chars = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        if len(chars) != len(joined):  # characters beyond the first plane
            chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1
    text_start = np.concatenate(([0], np.cumsum(lens)))
    inside = alnum()[chars]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a text never ends the chunk inside a word
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, text_start)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end, joined, text_start)
    power, inverse = _powers(len(chars))
    with np.errstate(over="ignore"):
        total = np.multiply(chars, power[: len(chars)], dtype=np.uint64)
        np.cumsum(total, out=total)
        low_sum = np.where(start > 0, total[start - 1], np.uint64(0))
        hashes = mix((total[end - 1] - low_sum) * inverse[start])
    return Words(hashes, first, start, end, joined, text_start)


def word_hash(word: str) -> int:
    """The hash ``words`` gives to one word."""
    w = words([word]).hashes
    return int(w[0]) if len(w) else 0


def chunks(texts: list[list[str | None]], limit: int = CHUNK) -> Iterator[slice]:
    """Slices of rows whose texts (parallel columns) have about ``limit`` characters."""
    n = len(texts[0]) if texts else 0
    begin = total = 0
    for i in range(n):
        total += sum(len(c[i] or "") for c in texts) + 1
        if total >= limit:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < n:
        yield slice(begin, n)


def pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words within each text, and the offsets of each text's pairs."""
    n = len(w.hashes)
    counts = np.maximum(w.counts - 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        both = mix(w.hashes[:-1] * np.uint64(3) + w.hashes[1:] * np.uint64(0xD6E8FEB86659FD93))
    keep = np.ones(n - 1, dtype=bool)
    borders = w.first[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    keep[borders - 1] = False
    return both[keep], first


def minima(values: np.ndarray, first: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` min-hash values (uint32) for each group; an empty group gets the highest value."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, size=count, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, size=count, dtype=np.uint64)
    n = len(first) - 1
    out = np.full((n, count), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    at = first[full]
    with np.errstate(over="ignore"):
        for i in range(count):
            h = ((values * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(h, at)
    return out


def long_sketch(values: np.ndarray, first: np.ndarray, words: int, seed: int = 1) -> np.ndarray:
    """A sketch of ``words`` 64-bit words for each group: one scrambled bit of each of 64 * words min-hashes, two to a product."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, size=32 * words, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, size=32 * words, dtype=np.uint64)
    out = np.zeros((len(first) - 1, words), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    at = first[full]
    product, half = np.empty(len(values), np.uint64), np.empty(len(values), np.uint32)
    for w in range(words):
        bits = np.zeros(len(full), np.uint64)
        for i in range(64):
            if not i % 2:
                k = 32 * w + i // 2
                np.add(np.multiply(values, mul[k], out=product), add[k], out=product)
            np.copyto(half, product.view(np.uint32)[i % 2 :: 2])
            least = np.minimum.reduceat(half, at)
            bits |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << np.uint64(i)
        out[full, w] = bits
    return out


def one_bit(signature: np.ndarray) -> np.ndarray:
    """64 min-hashes as a 64-bit sketch: one scrambled bit of each."""
    bits = (signature[:, :64] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


def order_print(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each group's values in their order; equal for equal word runs."""
    n = len(first) - 1
    out = np.zeros(n, dtype=np.uint64)
    size = np.diff(first)
    full = np.flatnonzero(size > 0)
    if len(full):
        at = first[full]
        place = np.arange(len(values)) - np.repeat(first[:-1], size)
        with np.errstate(over="ignore"):
            scrambled = mix(values + mix(place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            out[full] = mix(np.add.reduceat(scrambled, at) + size[full].astype(np.uint64))
    return out


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group, with new offsets."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    if len(v):
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(n + 1))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
