"""Per-word results kept across batches, so that a model looks at each distinct word once and at texts by lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Words whose results one Python worker keeps per model; beyond it they are dropped and gathered anew.
KEPT_WORDS = 300_000
#: Words looked at together; their n-grams take some 100 times the words' memory.
COMPUTED = 6_000


class WordRows:
    """A matrix of rows by word, filled on demand by ``compute(words) -> (n, width)``."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int):
        self.compute, self.width = compute, width
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, width), np.float32)
        self.used = 0

    def of(self, texts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row, all texts after each other, and the words per text."""
        new = set().union(*texts).difference(self.at)
        if self.used + len(new) > KEPT_WORDS and self.used:
            self.at, self.used = {}, 0
            new = set().union(*texts)
        words = list(new)
        for first in range(0, len(words), COMPUTED):
            some = words[first : first + COMPUTED]
            got = self.compute(some)
            need = self.used + len(some)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows) // 2), self.width), np.float32)])
            self.rows[self.used : need] = got
            self.at.update(zip(some, range(self.used, need)))
            self.used = need
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        index = np.empty(int(counts.sum()), np.int64)
        end = 0
        for words_, n in zip(texts, counts.tolist()):
            index[end : end + n] = np.fromiter(map(self.at.__getitem__, words_), np.int64, n)
            end += n
        return index, counts


def codes_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words after each other, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def slices_of_texts(texts: Sequence[str], most: int = 1 << 21):
    """(first, texts) groups of at most so many characters, or one text."""
    first, size, group = 0, 0, []
    for i, text in enumerate(texts):
        if group and size + len(text) > most:
            yield first, group
            first, size, group = i, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield first, group
