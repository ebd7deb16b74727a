"""Words of a text, their hashes and the hashes of runs of words (shingles).

Words are the maximal runs of letters and digits, whatever the letter case, accents, compatibility forms, HTML character references
and invisible characters. Null and blank texts have none.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


class _Fold(dict):
    """str.translate table that drops marks and invisible characters; filled as characters are met."""

    def __missing__(self, code: int):
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Me", "Cf") else code
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Text with character references resolved, folded case, and without accents and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()).translate(_FOLD)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    t = fold(text)
    return _ASCII_WORD.findall(t) if t.isascii() else _WORD.findall(t)


def word_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) with offsets in the original text; the same words as words(text).

    Slow: character references and characters are folded one by one, each with the place it came from.
    """
    if not text:
        return []
    out, start, end = [], [], []
    pieces, at = [], 0
    for m in re.finditer(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", text):
        pieces += [(c, i, i + 1) for i, c in enumerate(text[at : m.start()], at)]
        got = html.unescape(m.group())
        if got == m.group():
            pieces += [(c, i, i + 1) for i, c in enumerate(got, m.start())]
        else:
            pieces += [(c, m.start(), m.end()) for c in got]
        at = m.end()
    pieces += [(c, i, i + 1) for i, c in enumerate(text[at:], at)]
    chars = []
    for c, a, b in pieces:
        for x in fold_char(c):
            chars.append(x)
            start.append(a)
            end.append(b)
    for m in _WORD.finditer("".join(chars)):
        out.append((m.group(), start[m.start()], end[m.end() - 1]))
    return out


def fold_char(c: str) -> str:
    if c.isascii():
        return c.lower()
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold()).translate(_FOLD)


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it has grown to `most` words, so that any vocabulary fits in memory."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def shingles(ws: list[str], k: int) -> np.ndarray:
    """The distinct hashes of all runs of k consecutive words, ascending; none if there are fewer words."""
    n = len(ws) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = hash_words(ws)
    h = a[:n].copy()
    for j in range(1, k):
        h *= _P
        h += mix(a[j : j + n] + np.uint64(j))
    return np.unique(mix(h))


_ODD = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_ODD, -1, 1 << 64)


class Runs:
    """Hashes of all runs of k consecutive words for any k, from the words' hashes: a polynomial of the words, by running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        ones = np.ones(n, np.uint64)
        up = np.multiply.accumulate(ones * np.uint64(_ODD)) if n else ones
        self.down = np.multiply.accumulate(ones * np.uint64(_BACK)) if n else ones
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(hashes) * up)])

    def of(self, k: int) -> np.ndarray:
        """One hash for each place at which a run of k words begins, in order."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)
