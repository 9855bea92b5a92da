"""How closely the words of a query stand together in a field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

# The largest steps between neighbouring words of each kind of hit.
GAPS = (("exact", 1), ("near", 3), ("ordered", 10))
FIELDS = ("path", "title", "h1", "heading", "intro", "body")
HITS = ("none", "scattered", "ordered", "near", "exact")


def phrase_tokens(text: Column) -> Column:
    return tokenize(F.regexp_replace(F.coalesce(text, F.lit("")), r"[-_/\\]+", " "))


def _places(tokens: Column, word: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i).otherwise(-1)), lambda i: i >= 0)


def _in_order(query: Column, tokens: Column, gap: int) -> Column:
    """Whether the query's words can be placed in order with steps of at most gap: the set of places reachable by each word in turn."""

    def step(reached: Column, word: Column) -> Column:
        ahead = F.array_distinct(F.flatten(F.transform(reached, lambda p: F.sequence(p + 1, p + gap))))
        return F.array_intersect(_places(tokens, word), ahead)

    rest = F.slice(query, F.lit(2), F.greatest(F.size(query) - 1, F.lit(0)))
    return F.size(F.aggregate(rest, _places(tokens, F.get(query, 0)), step)) > 0


def phrase_hit(query: Column, tokens: Column) -> Column:
    """exact, near, ordered, scattered or none, of two token arrays; one word alone is exact wherever it stands."""
    known = F.forall(query, lambda t: F.array_contains(tokens, t))
    out = F.lit("scattered")
    for name, gap in reversed(GAPS):
        out = F.when(_in_order(query, tokens, gap), name).otherwise(out)
    return F.when((F.size(query) == 0) | ~known, "none").when(F.size(query) == 1, "exact").otherwise(out)


def hit_rank(hit: Column) -> Column:
    return F.array_position(F.array(*[F.lit(h) for h in HITS]), hit).cast("int") - 1


def best_field(hits: dict[str, Column]) -> Column:
    """The first field, in the order of FIELDS, with the strongest hit; none if there is no hit."""
    best = F.greatest(*[hit_rank(h) for h in hits.values()])
    out = F.lit("none")
    for field in reversed([f for f in FIELDS if f in hits]):
        out = F.when(hit_rank(hits[field]) == best, field).otherwise(out)
    return F.when(best == 0, "none").otherwise(out)
