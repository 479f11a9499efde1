"""Words of texts as numbers, for operators that work on whole texts in numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np


def ascii_words(text: str) -> list[str]:
    """The words between ASCII white space, as SPACE_CLASS parts them: other spaces belong to words."""
    other = _SEPARATORS if text.isascii() else _OTHER_SPACES
    return [w.decode() for w in text.encode().split()] if other.search(text) else text.split()


#: Characters that str.split takes for white space and bytes.split doesn't: those of ASCII, and all.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTable:
    """What a function says of each distinct word, kept for the words seen lately.

    ``describe`` gets a list of words and gives an array with a row for each.
    After ``most`` words the table begins anew, which costs time only."""

    def __init__(self, describe: Callable[[list[str]], np.ndarray], most: int = 500_000, split: Callable[[str], list[str]] = str.split):
        self.describe, self.most, self.split = describe, most, split
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.rows = _Numbers(), None

    def look_up(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words of all texts, and where each text's words end.

        Words are what split gives; by default they are parted by white space."""
        if len(self.numbers) > self.most:
            self._reset()
        number, found = self.numbers.__getitem__, []
        for t in texts:
            words = self.split(t)
            found.append(np.fromiter(map(number, words), dtype=np.int32, count=len(words)))
        if self.numbers.new:
            fresh = self.describe(self.numbers.new)
            self.numbers.new.clear()
            have = len(self.numbers) - len(fresh)
            if self.rows is None:
                self.rows = np.zeros((max(1024, len(fresh)), *fresh.shape[1:]), fresh.dtype)
            if len(self.numbers) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), len(self.numbers)), *fresh.shape[1:]), fresh.dtype)
                grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have : len(self.numbers)] = fresh
        ends = np.cumsum([len(x) for x in found], dtype=np.int64)
        own = np.concatenate(found) if found else np.zeros(0, np.int32)
        if self.rows is None:
            self.rows = self.describe([""])[:0]
        return self.rows[own], ends


def sums_by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of values between consecutive ends; texts without words give zeros."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else total[:0]
