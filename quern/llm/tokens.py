"""Words and their hashes, in whole batches."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: One ideograph or kana, or a run of other letters and digits.
TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class WordHash:
    """Stable 64-bit hashes of words, with a bounded cache."""

    def __init__(self, most: int = 400_000):
        self.cache: dict[str, int] = {}
        self.most = most

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > self.most:
            self.cache.clear()
        for w in words.difference(self.cache):
            b = w.encode("utf-8", "surrogatepass")
            self.cache[w] = zlib.crc32(b) | zlib.crc32(b, 0x5BD1E995) << 32

    def __call__(self, ws: list[str]) -> np.ndarray:
        different = set(ws)
        if not different <= self.cache.keys():
            self._learn(different)
        return np.fromiter(map(self.cache.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits (a finaliser by multiplications and shifts)."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the windows of q words; fewer than q words make one window."""
    if len(h) == 0:
        return h
    q = min(q, len(h))
    out = np.zeros(len(h) - q + 1, dtype=np.uint64)
    for j in range(q):
        out = out * np.uint64(0x100000001B3) + h[j : len(h) - q + 1 + j]
    return mix(out)


def is_ideographic(ws: list[str]) -> bool:
    """Most words are single ideographs or kana."""
    return 2 * sum(len(w) == 1 and w >= "぀" for w in ws) > len(ws)


def is_wide(text: str, n: int) -> bool:
    """is_ideographic of the n words of a text, by its characters."""
    return IDEOGRAPH.search(text) is not None and 2 * len(IDEOGRAPH.findall(text)) > n
