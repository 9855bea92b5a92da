"""Profiles of Markdown documents: title, outline, introduction, aliases, questions, purpose. Only the outline needs Python; it is the chunker's pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mentions, paths
from ..functions.text import slugify, tokenize
from .chunker import blocks, front_matter

# First words of a heading that make it a question, and how many characters a summary has.
QUESTION_WORDS = ("how", "why", "what", "when", "where", "which", "can", "should", "do", "does", "is", "are")
SUMMARY_CHARS = 480
OUTLINE = "array<struct<level:int,text:string>>"


def outline_of(text: str) -> tuple[str, list[dict], str | None]:
    """(title in the front matter, headings, introduction): the first paragraph after the first heading, or the first of all where there is no heading."""
    lines = text.split("\n")
    at, named = front_matter(lines)
    headings, first, after, seen = [], None, None, False
    for block in blocks(lines, at):
        if block.kind == "heading":
            seen = True
            if block.text:
                headings.append({"level": block.level, "text": block.text})
        elif block.kind == "paragraph":
            found = "\n".join(lines[block.first : block.last + 1]).strip()
            first = first or found
            if seen:
                after = after or found
    return named, headings, after if seen else first


def outlines(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, named, outline, intro) of each document. Null text counts as empty."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [outline_of(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"path": pdf["path"], "named": [f[0] for f in found], "outline": [f[1] for f in found], "intro": [f[2] for f in found]})

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(step, f"path string, named string, outline {OUTLINE}, intro string")


def clamp(text: Column, most: int = SUMMARY_CHARS) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def heading_aliases(outline: Column) -> Column:
    """array<struct<surface, normalized, depth, section_path>>: each heading under the headings above it, outermost first.

    The fold keeps the open headings; one of a level ends those of that level and deeper ones.
    """
    open_type, out_type = OUTLINE, "array<struct<surface:string,normalized:string,depth:int,section_path:array<string>>>"
    start = F.struct(F.array().cast(open_type).alias("open"), F.array().cast(out_type).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["level"] < h["level"])
        name = F.trim(F.regexp_replace(F.lower(h["text"]), r"\s+", " "))
        alias = F.struct(h["text"].alias("surface"), name.alias("normalized"), h["level"].alias("depth"), F.transform(above, lambda o: o["text"]).alias("section_path"))
        return F.struct(F.array_append(above, h).alias("open"), F.array_append(acc["out"], alias).alias("out"))

    return F.aggregate(F.filter(outline, lambda h: F.trim(h["text"]) != ""), start, step)["out"]


def phrase_match(tokens: Column, aliases: Column) -> Column:
    """Whether the query's phrase is in a heading or a heading in it, both as lower-case letters and digits."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    phrase = plain(F.array_join(tokens, " "))
    inside = lambda a: (plain(a["normalized"]) != "") & (F.contains(plain(a["normalized"]), phrase) | F.contains(phrase, plain(a["normalized"])))
    return (phrase != "") & F.exists(aliases, inside)


def package_segment(path: Column) -> Column:
    """The folder after a folder named packages or package, or null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)packages?/([^/]+)/", 1), F.lit(""))


def aliases_of(path: Column, title: Column, h1: Column, outline: Column) -> Column:
    """array<struct<kind, value, confidence, origin>>, the first of each kind and value, letter case aside."""
    bare = F.regexp_replace(path, r"\.[^.]+$", "")
    alias = lambda kind, value, confidence, origin: F.struct(F.lit(kind).alias("kind"), F.trim(value).alias("value"), F.lit(confidence).alias("confidence"), F.lit(origin).alias("origin"))
    package = F.regexp_extract(path, r"(?i)(?:^|/)packages/([^/]+)/README\.md$", 1)
    every = F.concat(
        F.array(alias("path", bare, "high", "path")),
        F.transform(F.filter(F.split(bare, r"[\\/]"), lambda s: (s != "") & (s != "docs")), lambda s: alias("path", s, "medium", "path")),
        F.array(alias("filename", paths.stem(path), "high", "filename"), alias("title", title, "high", "title")),
        F.when(h1.isNotNull() & (h1 != title), F.array(alias("title", h1, "high", "h1"))).otherwise(F.array().cast("array<struct<kind:string,value:string,confidence:string,origin:string>>")),
        F.transform(F.filter(outline, lambda h: h["level"].between(2, 3)), lambda h: alias("heading", h["text"], "medium", "heading")),
        F.when(package != "", F.array(alias("package", package, "high", "package_name"))).otherwise(F.array().cast("array<struct<kind:string,value:string,confidence:string,origin:string>>")),
    )
    some = F.filter(every, lambda a: a["value"] != "")
    keys = F.transform(some, lambda a: F.concat(a["kind"], F.lit(":"), F.lower(a["value"])))
    return F.filter(some, lambda a, i: F.array_position(keys, F.concat(a["kind"], F.lit(":"), F.lower(a["value"]))) == i + 1)


def source_profiles(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each document: path, title, h1, outline, heading_aliases, intro, summary, aliases, questions, purpose, package and version segments, token_count."""
    c = F.col
    words = docs.select(c(path).alias("p"), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint").alias("token_count"))
    found = outlines(docs, path, text).join(words, c("path") == c("p")).drop("p")
    found = found.withColumn("h1", F.get(F.transform(F.filter("outline", lambda h: h["level"] == 1), lambda h: h["text"]), 0))
    leaf = paths.stem(c("path"))
    found = found.withColumn("title", F.when(F.trim("named") != "", F.trim("named")).otherwise(F.coalesce("h1", F.when(leaf != "", leaf).otherwise(F.substring_index("path", "/", -1)))))
    api = F.size(F.filter("outline", lambda h: h["text"].rlike(mentions.API_HEADING)))
    first = lambda t: F.get(F.split(F.lower(t), r"\s+"), 0)
    asks = lambda t: F.endswith(t, F.lit("?")) | (first(t).isin(*QUESTION_WORDS) & t.rlike(r"\s"))
    return found.select(
        "path", "title", "h1", "outline", heading_aliases(c("outline")).alias("heading_aliases"), "intro",
        clamp(F.concat(F.coalesce("h1", "title"), F.lit("\n\n"), "intro")).alias("summary"), aliases_of(c("path"), c("title"), c("h1"), c("outline")).alias("aliases"),
        F.filter(F.transform("outline", lambda h: h["text"]), asks).alias("questions"), mentions.purpose(c("path"), c("title"), api)["purpose"].alias("purpose"),
        package_segment(c("path")).alias("package_segment"), paths.version_segment(c("path")).alias("version_segment"), "token_count",
        F.transform("outline", lambda h: slugify(h["text"])).alias("slugs"), tokenize(c("title")).alias("title_tokens"),
    )
