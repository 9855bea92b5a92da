"""Markdown texts as sections: one row for each heading, with its breadcrumb."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")


def split_sections(text: str, title: str) -> list[tuple[int, list[str], str]]:
    """(level, heading path, body) in order. Text before the first heading is a section of level 1 named title; headings in code fences don't count."""
    lines = text.split("\n")
    if lines and lines[0].rstrip() == "---" and "---" in (rest := [x.rstrip() for x in lines[1:]]):
        lines = lines[rest.index("---") + 2 :]  # front matter
    stack: list[tuple[int, str]] = []
    out: list[tuple[int, list[str], list[str]]] = []
    fence = ""
    for line in lines:
        mark = _FENCE.match(line)
        if mark:
            run = mark[1]
            if not fence:
                fence = run
            elif run[0] == fence[0] and len(run) >= len(fence) and not line.strip().strip(run[0]):
                fence = ""
        found = None if fence or mark else _HEADING.match(line)
        if found:
            level = len(found[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, (found[2] or "").strip()))
            out.append((level, [x for _, x in stack], []))
        elif out:
            out[-1][2].append(line)
        elif line.strip():
            out.append((1, [title], [line]))
    return [(level, path, "\n".join(body).strip("\n")) for level, path, body in out]


def sections(docs: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(key, section, level, heading_path, body, tokens) of every section; null and blank texts have none."""

    def step(batches):
        for pdf in batches:
            rows = [
                (k, i, level, path, body, -(-len(body) // 4))
                for k, t, name in zip(pdf[key], pdf[text], pdf[title]) if isinstance(t, str)
                for i, (level, path, body) in enumerate(split_sections(t, name if isinstance(name, str) else ""))
            ]
            yield pd.DataFrame(rows, columns=[key, "section", "level", "heading_path", "body", "tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text, title).mapInPandas(step, f"{key} {kind}, section int, level int, heading_path array<string>, body string, tokens int")
