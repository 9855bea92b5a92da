"""The retrieval tokenizer over Arrow batches: each distinct word of a task's texts is tokenized once, texts are arrays of word numbers. Gives what text.tokenize gives, with tokens split at underscores as postings have them."""

from __future__ import annotations

import re

import numpy as np

from .text import STOP_WORDS

# What text.SEPARATORS names, as bytes; all become white space, at which bytes are split.
_MARKS = b""".,;:!?()[]{}<>"'`/\\@#$%&*+=|~"""
_SPACES = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_STOPS = frozenset(STOP_WORDS)
#: Distinct words that are kept between batches.
KEPT = 1_000_000


def word_terms(word: str) -> list[str]:
    """The terms of one word without separators, in order."""
    if "_" in word or re.search("[a-z][A-Z]|[A-Z][a-z]", word):
        cut = re.sub("([A-Z]+)([A-Z][a-z])", "\\1\x01\\2", re.sub("([a-z0-9])([A-Z])", "\\1\x01\\2", word.replace("_", "\x01")))
        found = [p.lower() for p in cut.split("\x01") if p] + [word.lower()]
    else:
        found = [word.lower()]
    clean = [re.sub("[^a-z0-9_]", "", t) for t in found if len(t) > 1]
    out: list[str] = []
    for t in clean:
        if len(t) > 1 and t not in _STOPS:
            out.extend([p for p in t.split("_") if p] if "_" in t else [t])
    return out


class Words(dict):
    """Numbers of words, by their bytes. terms: the code of each wanted term; other terms have the code -1."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms, self.counts, self.codes = terms, [], []

    def __missing__(self, word: bytes) -> int:
        found = word_terms(word.decode("utf-8", "replace"))
        self.counts.append(len(found))
        self.codes.extend(self.terms.get(t, -1) for t in found)
        self[word] = number = len(self)
        return number

    def forget(self) -> None:
        self.clear()
        self.counts, self.codes = [], []

    def encoded(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of every term of texts, in order."""
        number = self.__getitem__
        ids = [np.fromiter(map(number, t.translate(_SPACES).split()), np.int64) if t else np.empty(0, np.int64) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        words = np.concatenate(ids) if ids else np.empty(0, np.int64)
        counts, codes = np.array(self.counts, np.int64), np.array(self.codes, np.int64)
        per_word = counts[words] if len(words) else words
        text = np.repeat(np.repeat(np.arange(len(ids)), sizes), per_word)
        return text, codes[spread((np.cumsum(counts) - counts)[words] if len(words) else words, per_word)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... up to counts[i] numbers, for each i in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts - starts, counts)
