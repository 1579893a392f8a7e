"""Words of a text and their hashes, for use inside Arrow functions.

A word is a run of letters or digits after NFKC, case folding and removal of zero-width characters. A text with words counted
by occurrence is a set of (word, k-th occurrence) tokens, each hashed to 64 bits.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Zero-width characters and joiners, as a pattern.
INVISIBLE = re.compile("[" + "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])) + "]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """NFKC, zero-width characters out, case folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    return WORD.findall(plain(text)) if text else []


class Hasher:
    """64-bit hashes of words, with a cache of bounded size. The lowest bit tells whether a word has a digit."""

    def __init__(self, most: int = 1 << 17):
        self.cache: dict[str, int] = {}
        self.most = most

    def __call__(self, many: list[str]) -> np.ndarray:
        out = list(map(self.cache.get, many))
        if None in out:
            out = [self._hash(w) if h is None else h for w, h in zip(many, out)]
        return np.array(out, dtype=np.uint64)

    def _hash(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w) & ~1 | (not w.isalpha() and any(c.isdigit() for c in w))
        if len(w) <= 64:
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[w] = h
        return h


def without_digits(hashes: np.ndarray) -> np.ndarray:
    """The hashes of words without digits."""
    return hashes[(hashes & np.uint64(1)) == 0]


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct token hashes: the k-th occurrence of a word is a token of its own."""
    if not len(hashes):
        return hashes
    h = np.sort(hashes)
    first = np.concatenate(([True], h[1:] != h[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    k = (np.arange(len(h)) - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = h + k * MIX
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return np.sort(x)


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a token set, as a signed number."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class MinHash:
    """Band keys of token sets: `bands` keys of `rows` minima each. Minima are of 32 bits, which vector units multiply fast."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.c = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each band."""
        least = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        with np.errstate(over="ignore"):
            short = (tokens >> np.uint64(32)).astype(np.uint32)
            for i in range(0, len(short), 256):  # long texts in steps, so that memory stays small
                np.minimum(least, (short[i : i + 256, None] * self.a).min(axis=0), out=least)
            keys = least.astype(np.uint64).reshape(self.bands, self.rows) * MIX
            keys = ((keys ^ (keys >> np.uint64(32))) * self.c).sum(axis=1)
            keys ^= keys >> np.uint64(29)
            keys = keys * np.uint64(0x94D049BB133111EB) + np.arange(self.bands, dtype=np.uint64)
        return keys.view(np.int64)


def folded(tokens: np.ndarray, bits: int = 512) -> np.ndarray:
    """Fingerprint of `bits` bits: the parity of the tokens that fall on each bit.

    Two sets' fingerprints differ in at most as many bits as the sets have tokens apart, so a large Hamming distance proves a large difference.
    """
    parity = (np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)
