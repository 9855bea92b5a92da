"""Porter's stemming algorithm, as published in 1980, repeated until the word no longer changes. It runs on distinct terms only."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Distinct terms whose stems are broadcast, some tens of megabytes; more are joined by a shuffle.
BROADCAST_STEMS = 500_000

_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """One pass; words of one or two letters stay."""
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _SECOND), _THIRD)
    for end in sorted(_FOURTH, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(word: str, passes: int = 9) -> str:
    """porter, again until nothing changes. Words with other characters than a-z stay."""
    if not re.fullmatch("[a-z]+", word):
        return word
    for _ in range(passes):
        new = porter(word)
        if new == word:
            break
        word = new
    return word


def with_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms with the column stem. The distinct terms are stemmed, in Arrow batches, and joined back, by a broadcast up to BROADCAST_STEMS of them."""

    def step(batches):
        for pdf in batches:
            yield pd.DataFrame({"__term": pdf[term], "stem": [stem(x) for x in pdf[term]]})

    stems = written(terms.select(term).where(F.col(term).isNotNull()).distinct().mapInPandas(step, "__term string, stem string"), "stems")
    small = F.broadcast if stems.count() <= BROADCAST_STEMS else lambda df: df
    return terms.join(small(stems), F.col(term) == F.col("__term"), "left").drop("__term")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Arrays of tokens with each token's stem; a worker stems a token once."""
    return tokens.map(lambda ts: None if ts is None else [_remembered(t) for t in ts])


@functools.lru_cache(maxsize=200_000)
def _remembered(word: str) -> str:
    return stem(word)
