"""Path predicates and path topology as column expressions; glob patterns become regular expressions on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: `**/` any directories, `**` anything, `*` and `?` inside a segment, `{a,b}` either."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            i += 1
            if c == "{":
                depth += 1
                out.append("(?:")
            elif c == "}" and depth:
                depth -= 1
                out.append(")")
            elif c == "," and depth:
                out.append("|")
            else:
                out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
    return "^" + "".join(out) + (")" * depth) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return F.translate(path, "\\", "/").rlike(glob_regex(pattern))


def first_match(path: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Value of the first rule (glob, value) that fits."""
    out = F.lit(None).cast("string") if default is None else default
    for pattern, value in reversed(rules):
        out = F.when(matches_glob(path, pattern), F.lit(value)).otherwise(out)
    return out


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != "")) - 1


def is_index(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).rlike(r"^(index|readme)\.[a-z]+$")


def version_segment(path: Column) -> Column:
    """First directory that names a version, like v2 or 1.4; null if none."""
    return F.get(F.filter(F.split(path, "/"), lambda s: s.rlike(r"^v?[0-9]+(\.[0-9x]+)*$")), 0)


def ancestors(path: Column) -> Column:
    """array<string> of all directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
