"""Markdown documents as chunks: sections by heading, filled greedily with whole blocks, with breadcrumbs, line ranges and ids.

The form of the ids (what is hashed, and to how many characters) is fixed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)([^`]*)$")
_ITEM = re.compile(r"( {0,3})(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_COLUMNS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Blocks that are split at their own boundaries, and only beyond twice the limit.
ATOMIC = ("code", "table", "list", "blockquote")
SCHEMA = (
    "stable_key string, version_id string, path string, doc_id string, heading_path array<string>, heading_level int, chunk_index int, chunk_count int, title string, "
    "body string, tokens int, content_hash string, start_line int, end_line int, heading_slug string, warning string, part int, parts int"
)


class Block(NamedTuple):
    """Lines first to last (from 0, last included); level and text of headings only."""

    kind: str
    first: int
    last: int
    level: int = 0
    text: str = ""


class Part(NamedTuple):
    text: str
    tokens: int
    first: int
    last: int
    warning: str | None = None
    part: int | None = None
    parts: int | None = None


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def sha(text: str, n: int = 64) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def slug(text: str) -> str:
    return re.sub(r"\s+", "-", re.sub(r"[^a-z0-9\s-]", "", text.lower()).strip())


def _plain(text: str) -> str:
    """A heading's own text and inline code; emphasised and linked parts are not of it."""
    text = re.sub(r"!?\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"(\*\*|__)(?=\S).+?(?<=\S)\1|(?<![\w*])([*_])(?=[^\s*_]).+?(?<=[^\s*_])\2(?![\w*])", "", text)
    return re.sub(r"`+([^`]*)`+", r"\1", text).strip()


def front_matter(lines: list[str]) -> tuple[int, str]:
    """(number of lines before the text, title in the front matter)."""
    if lines and lines[0].rstrip() == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip() == "---":
                named = [m[1] for m in (re.match(r"title:[ \t]*(.+)", x) for x in lines[1:i]) if m]
                return i + 1, named[0].strip().strip("\"'") if named else ""
    return 0, ""


def _starts(line: str) -> bool:
    """Whether a line ends a paragraph above it."""
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") or re.match(r" {0,3}(?:[-*+]|1[.)])[ \t]+\S", line))


def blocks(lines: list[str], at: int = 0) -> Iterator[Block]:
    """The blocks of the first level in order: heading, code, list, table, blockquote, rule, paragraph."""
    n = len(lines)
    while at < n:
        line = lines[at]
        if not line.strip():
            at += 1
            continue
        first = at
        heading, fence = _ATX.match(line), _FENCE.match(line)
        if heading:
            yield Block("heading", at, at, len(heading[1]), _plain(heading[2] or ""))
            at += 1
        elif fence:
            at += 1
            while at < n and not (re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[at])):
                at += 1
            yield Block("code", first, min(at, n - 1))
            at += 1
        elif _RULE.match(line):
            yield Block("rule", at, at)
            at += 1
        elif line.startswith(("    ", "\t")):
            last = at
            while at < n and (not lines[at].strip() or lines[at].startswith(("    ", "\t"))):
                last = at if lines[at].strip() else last
                at += 1
            yield Block("code", first, last)
            at = last + 1
        elif line.lstrip().startswith(">"):
            while at < n and lines[at].strip() and (lines[at].lstrip().startswith(">") or not _starts(lines[at])):
                at += 1
            yield Block("blockquote", first, at - 1)
        elif _ITEM.match(line):
            last = at
            at += 1
            while at < n:
                if not lines[at].strip():
                    at += 1
                    continue
                after_blank = last < at - 1
                inner = _ITEM.match(lines[at]) and not _RULE.match(lines[at]) or lines[at].startswith(("  ", "\t"))
                if not inner and (after_blank or _starts(lines[at])):
                    break
                last = at
                at += 1
            yield Block("list", first, last)
            at = last + 1
        elif "|" in line and at + 1 < n and "-" in lines[at + 1] and _COLUMNS.match(lines[at + 1]):
            at += 2
            while at < n and lines[at].strip() and not _starts(lines[at]):
                at += 1
            yield Block("table", first, at - 1)
        else:
            at += 1
            level = 0
            while at < n and lines[at].strip():
                under = _UNDERLINE.match(lines[at])
                if under:
                    level = 1 if under[1][0] == "=" else 2
                    break
                if _starts(lines[at]):
                    break
                at += 1
            if level:
                yield Block("heading", first, at, level, _plain(" ".join(x.strip() for x in lines[first:at])))
                at += 1
            else:
                yield Block("paragraph", first, at - 1)


def _text(lines: list[str], first: int, last: int, indented: bool = False) -> str:
    out = "\n".join(lines[first : last + 1])
    return out.rstrip() if indented else out.strip()


def _pieces(block: Block, lines: list[str]) -> list[tuple[int, int]]:
    """Line ranges of a list's items or a table's rows, the row of dashes with the header."""
    marks = list(range(block.first, block.last + 1))
    if block.kind == "table":
        starts = [block.first, *marks[2:]]
    else:
        edge = len(_ITEM.match(lines[block.first])[1])
        starts = [i for i in marks if (m := _ITEM.match(lines[i])) and len(m[1]) <= edge + 1]
    return [(a, max(i for i in range(a, b) if lines[i].strip() or i == a)) for a, b in zip(starts, [*starts[1:], block.last + 1])]


def _split_code(block: Block, lines: list[str], limit: int, count: Callable[[str], int]) -> list[Part]:
    """Parts of a code block cut at blank lines, each in the block's fence."""
    fence = _FENCE.match(lines[block.first])
    if fence:
        closed = block.last > block.first and re.match(r" {0,3}[`~]{3,}[ \t]*$", lines[block.last])
        body, head, begin = lines[block.first + 1 : block.last + (0 if closed else 1)], "```" + fence[2].strip(), block.first + 1
    else:
        body, head, begin = [x[4:] for x in lines[block.first : block.last + 1]], "```", block.first
    runs: list[tuple[int, list[str]]] = []
    for i, line in enumerate(body):
        if line.strip():
            if not runs or not body[i - 1].strip():
                runs.append((i, []))
            runs[-1][1].append(line)
    if len(runs) < 2:
        return []
    frame = count(f"{head}\n```\n")
    groups, used = [[runs[0]]], count("\n".join(runs[0][1]))
    for run in runs[1:]:
        cost = count("\n".join(run[1]))
        if used + cost + frame > limit:
            groups.append([])
            used = 0
        groups[-1].append(run)
        used += cost
    out = []
    for group in groups:
        text = head + "\n" + "\n\n".join("\n".join(x) for _, x in group) + "\n```"
        out.append(Part(text, count(text), begin + group[0][0], begin + group[-1][0] + len(group[-1][1]) - 1))
    return out


def _split_atomic(block: Block, lines: list[str], limit: int, count: Callable[[str], int]) -> list[Part]:
    """Parts of a list, table or code block; fewer than two where it has no boundary within."""
    if block.kind == "code":
        return _split_code(block, lines, limit, count)
    if block.kind == "blockquote":
        return []
    ranges: list[list[int]] = []
    used = 0
    for a, b in _pieces(block, lines):
        cost = count(_text(lines, a, b))
        if ranges and used + cost <= limit:
            ranges[-1][1] = b
            used = count(_text(lines, *ranges[-1]))
        else:
            ranges.append([a, b])
            used = cost
    return [Part(t := _text(lines, a, b), count(t), a, b) for a, b in ranges]


def fill(body: list[Block], lines: list[str], target: int, limit: int, count: Callable[[str], int] = estimate) -> list[Part]:
    """Parts of one section: the whole if within limit, else whole blocks up to target; a block over the limit is a part of its own.

    Lists, tables and code beyond twice the limit are split at items, rows and blank lines.
    """
    whole = lambda run: Part(t := _text(lines, run[0].first, run[-1].last), count(t), run[0].first, run[-1].last)
    if not body:
        return [Part("", 0, -1, -1)]
    if (one := whole(body)).tokens <= limit:
        return [one]
    out: list[Part] = []
    run: list[Block] = []
    used = 0
    for block in body:
        cost = whole([block]).tokens
        if run and (cost > limit or used + cost > target):
            out.append(whole(run))
            run, used = [], 0
        if cost <= limit:
            run.append(block)
            used += cost
            continue
        cut = _split_atomic(block, lines, limit, count) if cost > 2 * limit and block.kind in ATOMIC else []
        if len(cut) >= 2:
            note = f"Atomic {block.kind} block split across {len(cut)} parts ({cost} total tokens)."
            out += [p._replace(warning=note, part=i, parts=len(cut)) for i, p in enumerate(cut, 1)]
        else:
            name = f"Atomic {block.kind} block" if block.kind in ATOMIC else f"Block of type '{block.kind}'"
            out.append(whole([block])._replace(warning=f"{name} exceeds max_tokens ({cost} > {limit}); kept as single chunk."))
    return out + ([whole(run)] if run else [])


def document_chunks(text: str, path: str, target: int, limit: int, count: Callable[[str], int] = estimate) -> Iterator[tuple]:
    """Rows of SCHEMA. Text before the first heading is a section named by the front matter's title or the file; lines count from 1 after the front matter."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    skip, title = front_matter(lines)
    lines = lines[skip:]
    leaf = re.split(r"[\\/]", path)[-1]
    title = title or re.sub(r"\.[^.]+$", "", leaf) or leaf
    stack: list[tuple[int, str]] = []
    sections: list[tuple[list[str], int, list[Block]]] = []
    for block in blocks(lines):
        if block.kind == "heading":
            while stack and stack[-1][0] >= block.level:
                stack.pop()
            stack.append((block.level, block.text))
            sections.append(([t for _, t in stack], block.level, []))
        else:
            if not sections:
                sections.append(([title], 1, []))
            sections[-1][2].append(block)
    doc = sha(path, 16)
    for crumbs, level, body in sections:
        parts = fill(body, lines, target, limit, count)
        for i, p in enumerate(parts, 1):
            key, content = sha(f"{path}::{' > '.join(crumbs)}::{i}", 16), sha(p.text)
            yield (key, sha(f"{key}:{content}", 16), path, doc, crumbs, level, i, len(parts), crumbs[-1], p.text, p.tokens, content, p.first + 1, p.last + 1, slug(crumbs[-1]), p.warning, p.part, p.parts)


def chunks(docs: DataFrame, path: str, text: str, target: int = 500, limit: int = 800) -> DataFrame:
    """Chunks of every document (columns path and text), one row each; documents with null path or text, and blank ones, have none.

    A document is read by one task and streams through it; there is no shuffle. Sections of one document that have the same headings
    share keys, as the key is of path, headings and number alone.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def step(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["p"], pdf["t"]) if isinstance(p, str) and isinstance(t, str) for r in document_chunks(t, p, target, limit)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"part": "Int32", "parts": "Int32"})

    return docs.selectExpr(f"`{path}` AS p", f"`{text}` AS t").mapInPandas(step, SCHEMA)
