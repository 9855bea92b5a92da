"""Tokenizers and token-set measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the retrieval tokenizer. Question words are no stop words.
STOP_WORDS = (
    "a", "an", "the",
    "and", "or", "but", "nor", "so", "yet",
    "of", "to", "in", "on", "at", "by", "for", "with", "about", "as",
    "from", "into", "onto", "upon", "over", "under", "between",
    "is", "be", "are", "was", "were", "been", "being", "am",
    "do", "does", "did", "doing",
    "has", "have", "had", "having",
    "i", "you", "he", "she", "it", "we", "they",
    "my", "your", "his", "her", "its", "our", "their",
    "this", "that", "these", "those",
    "if", "then", "else", "than",
    "not", "no",
    "can", "could", "should", "would", "may", "might", "will", "shall", "must",
)
# The stop words of the light tokenizer for headings.
LIGHT_STOP_WORDS = ("a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "for", "is", "be", "are", "was", "with", "by", "as", "at")
#: White space and the punctuation that separates tokens; hyphen and underscore don't.
SEPARATORS = r"""[\s.,;:!?()\[\]{}<>"'`/\\@#$%&*+=|~]+"""
_MARK = "\u0001"


def tokenize(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, split_identifiers: bool = True) -> Column:
    """array<string> of lower-case tokens in order, with repeats, unstemmed.

    A token with an underscore or mixed case gives its parts and then the whole, so a capitalised word is there twice.
    """
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda t: t != "")
    if split_identifiers:

        def expand(t: Column) -> Column:
            cut = F.regexp_replace(F.translate(t, "_", _MARK), "([a-z0-9])([A-Z])", f"$1{_MARK}$2")
            parts = F.split(F.regexp_replace(cut, "([A-Z]+)([A-Z][a-z])", f"$1{_MARK}$2"), _MARK)
            compound = F.contains(t, F.lit("_")) | t.rlike("[a-z][A-Z]|[A-Z][a-z]")
            return F.when(compound, F.array_append(F.filter(F.transform(parts, F.lower), lambda p: p != ""), F.lower(t))).otherwise(F.array(F.lower(t)))

        raw = F.flatten(F.transform(raw, expand))
    else:
        raw = F.transform(raw, F.lower)
    clean = F.transform(F.filter(raw, lambda t: F.length(t) > 1), lambda t: F.regexp_replace(t, "[^a-z0-9_]", ""))
    return F.filter(clean, lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))


def light_tokens(text: Column) -> Column:
    """Distinct tokens between non-alphanumerics, without a trailing s of words over three letters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*LIGHT_STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda t: F.regexp_replace(t, "^(.{3,})s$", "$1")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(query: Column, tokens: Column) -> Column:
    """Share of the query's tokens, repeats counted, that are among tokens; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.filter(query, lambda t: F.array_contains(tokens, t))) / F.size(query)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
