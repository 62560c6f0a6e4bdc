"""Text primitives shared by the operators of this subpackage."""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Words whose hash a task keeps; only speed depends on it.
KEPT = 500_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text; none of a null."""
    return WORD.findall(text.lower()) if text else []


#: Bytes of Latin-1 that are letters or digits stay, all others become blanks.
_LATIN = bytes(c if chr(c).isalnum() else 32 for c in range(256))


def _keys(text: str | None) -> list[bytes | str]:
    """``words``, as Latin-1 bytes where a text (or else a word) has them: bytes are split several times faster."""
    if not text:
        return []
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return [_latin(w) for w in WORD.findall(text)]


def _latin(word: str) -> bytes | str:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return word


class _Places(dict):
    """Place of each word's hash in ``hashes``."""

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, word: bytes | str) -> int:
        plain = word if isinstance(word, str) else word.decode("latin-1")
        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")))
        return at


_places = _Places()


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the number of words of each text."""
    global _places
    if len(_places) >= KEPT:
        _places = _Places()
    lists = [_keys(t) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    at = np.fromiter(map(_places.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
    return np.array(_places.hashes, np.uint64)[at] if len(at) else np.zeros(0, np.uint64), n


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed multipliers of the well-known splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of_words(hashes: np.ndarray, n_words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of every sequence of ``length`` consecutive words within a text, and the text it belongs to."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(n_words)), n_words)
    m = len(hashes) - length + 1
    inside = text[:m] == text[length - 1 :]
    key = hashes[:m].copy()
    for i in range(1, length):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : m + i])
    return key[inside], text[:m][inside]
