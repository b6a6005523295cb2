"""Hashed character n-grams of words, worked out for many distinct words at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .common import mixed

_FIRST, _LAST = "\x02", "\x03"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def char_grams(words: list[str], sizes: Iterable[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of every n-gram of every word; the word's two ends count as characters, so affixes differ from inner runs."""
    codes = np.frombuffer("".join(_FIRST + w + _LAST for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    at, features = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        inside = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
        h = np.full(len(inside), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[inside + j]) * _MULTIPLIERS[j]
        at.append(word[inside])
        features.append((mixed(h) >> np.uint64(64 - bits)).astype(np.int64))
    empty = np.empty(0, np.int64)
    return (np.concatenate(at), np.concatenate(features)) if at else (empty, empty)


class WordRows(dict):
    """Rows of numbers for words, worked out in bulk for new words and kept; at most about `most` words are held."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, most: int = 150_000):
        super().__init__()
        self.rows_of, self.most, self.new, self.rows = rows_of, most, [], np.empty((1024, width))

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def places(self, words: list[str]) -> np.ndarray:
        """Row numbers in self.rows, valid until the next call."""
        if len(self) > self.most:
            self.clear()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.rows):
                grown = np.empty((2 * len(self), self.rows.shape[1]))
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[len(self) - len(self.new) : len(self)] = self.rows_of(self.new)
            self.new = []
        return found
