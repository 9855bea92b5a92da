"""Score terms of chunks and rules beyond the lexical ones: scope, anchors, role, structure."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import identifiers as I
from . import scoring as S

# Strength of a scope match by its level, and factors of roles, structure and boosts.
SCOPE_STRENGTH = {"module": 1.0, "project": 0.6, "team": 0.3, "company": 0.3}
ARCHIVE, IDEATION, EXAMPLE = 0.3, 0.5, 0.4
MENTION_ONLY, LEXICAL_ONLY = 0.15, 0.10
PATH_BOOST = {3: 1.7, 2: 1.4, 1: 1.1}
HEADING_BOOST = 1.2
CARD_BIAS = 1.2
#: Levels of a rule's scope that lock it into a pack.
LOCKING = ("company", "team", "project", "module")


def scope_match(query: Mapping[str, Column], scope: Mapping[str, Column]) -> Column:
    """Strength of the narrowest level that one query scope shares with a chunk's; a module counts only within the query's project, if it has one."""
    same = {k: query[k].isNotNull() & (query[k] == scope[k]) for k in SCOPE_STRENGTH if k in query}
    if "module" in same and "project" in query:
        same["module"] = same["module"] & (query["project"].isNull() | F.coalesce(query["project"] == scope["project"], F.lit(False)))
    out = F.lit(0.0)
    for level in reversed([k for k in SCOPE_STRENGTH if k in same]):
        out = F.when(same[level], F.lit(SCOPE_STRENGTH[level])).otherwise(out)
    return out


def best_scope(queries: list[Mapping[str, Column]], scope: Mapping[str, Column]) -> Column:
    """Over several query scopes; 0 for none."""
    found = [scope_match(q, scope) for q in queries] or [F.lit(0.0)]
    return found[0] if len(found) == 1 else F.greatest(*found)


def similar_files(a: Column, b: Column) -> Column:
    """Equal, or with a directory on either side, one the end of the other, once the usual top directories are gone."""
    x, y = I.normalized_file(a), I.normalized_file(b)
    nested = F.contains(x, F.lit("/")) | F.contains(y, F.lit("/"))
    return (a == b) | (x == y) | (nested & (F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))))


def mention_overlap(asked: Mapping[str, Column], anchors: Mapping[str, Column]) -> Column:
    """Share of the asked anchors, arrays by kind, that a chunk has; files also by their ends."""
    none = F.array().cast("array<string>")

    def matched(kind: str, values: Column) -> Column:
        own = F.coalesce(anchors.get(kind, none), none)
        if kind == "file":
            return F.size(F.filter(values, lambda v: F.exists(own, lambda o: similar_files(v, o))))
        return F.size(F.filter(values, lambda v: F.array_contains(own, v)))

    hits = [matched(kind, values) for kind, values in asked.items()]
    total = reduce(lambda a, b: a + b, [F.size(v) for v in asked.values()])
    return F.when(total > 0, reduce(lambda a, b: a + b, hits) / total).otherwise(F.lit(0.0))


def role_factor(role: Column, mode: Column) -> Column:
    focused = mode.isin("anchored", "signal_empty")
    return F.when(role == "archive", ARCHIVE).when(focused & (role == "ideation"), IDEATION).when(focused & (role == "example"), EXAMPLE).otherwise(1.0)


def structure_factor(mode: Column, scope: Column, mention: Column) -> Column:
    """Under an anchored query, chunks that share no scope count little."""
    return F.when((mode != "anchored") | (scope > 0), 1.0).when(mention > 0, MENTION_ONLY).otherwise(LEXICAL_ONLY)


def path_boost(shared: Column) -> Column:
    """By the number of stems that the query shares with the last three segments of the path."""
    return F.when(shared >= 3, PATH_BOOST[3]).when(shared == 2, PATH_BOOST[2]).when(shared == 1, PATH_BOOST[1]).otherwise(1.0)


def heading_boost(shared: Column) -> Column:
    return F.when(shared >= 3, HEADING_BOOST).otherwise(1.0)


def path_words(path: Column) -> Column:
    """The text of the last three segments of a path, without endings."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", ".", ".."))
    named = F.transform(parts, lambda s: F.translate(F.regexp_replace(s, r"\.[^.]+$", ""), "-_", "  "))
    return F.array_join(F.slice(named, F.greatest(F.size(named) - 2, F.lit(1)), F.lit(3)), " ")


def specificity(layer: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in S.SPECIFICITY.items():
        out = F.when(layer == name, weight).otherwise(out)
    return out


def chunk_score(bm25: Column, heading: Column, scope: Column, mention: Column, layer: Column, role: Column, mode: Column, index: Column, count: Column,
                in_heading: Column, in_path: Column) -> Column:
    """The final score of a chunk."""
    factor = specificity(layer) * role_factor(role, mode) * structure_factor(mode, scope, mention) * S.position_decay(index, count)
    return S.final_score(bm25, heading, scope, mention, factor * heading_boost(in_heading) * path_boost(in_path), count)


def card_score(bm25: Column, heading: Column, scope: Column, mention: Column, layer: Column, mode: Column) -> Column:
    """The final score of a rule: no role, place, heading or path terms, and a bias of its own."""
    return S.final_score(bm25, heading, scope, mention, specificity(layer) * structure_factor(mode, scope, mention) * CARD_BIAS)


def lock_path(layer: Column, scope: Mapping[str, Column], query: Mapping[str, Column]) -> Column:
    """How a constraint's scope covers one query scope; null where it doesn't. A company's constraint covers all but another company."""
    same = lambda k: F.coalesce((scope[k] != "") & (scope[k] == query[k]), F.lit(False))
    other = F.coalesce(scope["company"] != query["company"], F.lit(False))
    within = scope["project"].isNull() | F.coalesce(scope["project"] == query["project"], F.lit(False))
    inner = F.coalesce(F.concat(F.lit("module:"), query["module"]), F.concat(F.lit("project:"), query["project"]))
    return (
        F.when((layer == "company") & ~other, F.concat(F.lit("company:"), F.coalesce(scope["company"], F.lit("*")), F.lit(" (universal)")))
        .when((layer == "team") & same("team"), F.concat(F.lit("team:"), scope["team"]))
        .when((layer == "project") & same("project"), F.concat(F.lit("project:"), scope["project"], F.lit(" -> "), inner))
        .when((layer == "module") & same("module") & within, F.concat(F.lit("module:"), scope["module"]))
    )
