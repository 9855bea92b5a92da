"""Files as documents: a scan by globs, decoding by byte-order marks, DOCX as blocks, and Markdown rendered from blocks."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions.paths import matches_glob

# The default globs, how much of a text is judged, the shares of bad characters, and the warnings.
DEFAULT = ("**/*.{md,markdown,txt,docx,pdf}",)
SAMPLE, RETRY, NOISE = 1000, 0.1, 0.02
UNDECODED = "File does not look like UTF-8 text; some characters could not be decoded."
UNEVEN = "DOCX table has uneven row width; blank cells were inserted for chunking."
EMPTY = "File contains no text; nothing was indexed."

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCK = "struct<type: string, level: int, text: string, rows: array<array<string>>>"


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = DEFAULT) -> DataFrame:
    """(path, content, length, modificationTime) of the files under root that fit a pattern and none that begins with !; path is relative to root. Spark's readers don't see files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The reader gives a path with its scheme, percent-encoded in part; what follows the root's own name is kept.
    head = re.escape(root.rstrip("/").split("://", 1)[-1])
    path = F.regexp_replace("path", f"^[a-z0-9]*:?/*.*?{head}/+", "") if not root.startswith("/") else F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{head}/+", "")
    named = files.withColumn("path", path)
    wanted, unwanted = F.lit(False), F.lit(False)
    for p in patterns:
        if p.startswith("!"):
            unwanted = unwanted | matches_glob(F.col("path"), p[1:])
        else:
            wanted = wanted | matches_glob(F.col("path"), p)
    return named.where(wanted & ~unwanted).select("path", "content", "length", "modificationTime")


def _share(text: str, bad: str) -> float:
    head = text[:SAMPLE]
    return sum(head.count(c) for c in bad) / len(head) if head else 0.0


def decode(content: bytes) -> str:
    """UTF-8 or UTF-16 by the mark at the start; without one UTF-8, unless it is full of NULs and reads well as UTF-16LE."""
    even = lambda b: b[: len(b) - len(b) % 2]
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    if content.startswith(b"\xff\xfe"):
        return even(content[2:]).decode("utf-16-le", "replace")
    if content.startswith(b"\xfe\xff"):
        return even(content[2:]).decode("utf-16-be", "replace")
    text = content.decode("utf-8", "replace")
    if _share(text, "\0") > RETRY:
        wide = even(content).decode("utf-16-le", "replace")
        if _share(wide, "\0�") < RETRY:
            return wide
    return text


def _run_text(node: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: " ", f"{_W}br": lambda x: " ", f"{_W}cr": lambda x: " "}
    return re.sub(r"\s+", " ", "".join(parts[x.tag](x) for x in node.iter() if x.tag in parts)).strip()


def docx_blocks(content: bytes) -> tuple[list[tuple], list[str]]:
    """((type, level, text, rows) of each block, warnings): headings by style, list items with a dash, tables, paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                label = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId", "")] = label.get(f"{_W}val", "") if label is not None else ""
    out, notes = [], []
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            rows = [[_run_text(c) for c in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append(("table", None, None, rows))
                if len({len(r) for r in rows}) > 1:
                    notes.append(UNEVEN)
        elif node.tag == f"{_W}p" and (text := _run_text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.fullmatch(r"heading ?([1-6])", names.get(name, name), re.I) or re.fullmatch(r"heading ?([1-6])", name, re.I)
            listed = node.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(("heading", int(level[1]), text, None) if level else ("paragraph", None, f"- {text}" if listed else text, None))
    return out, notes


def render_table(rows: list[list[str]]) -> str:
    clean = [[re.sub(r"\s+", " ", c).replace("|", "\\|").strip() for c in row] for row in rows]
    clean = [r for r in clean if any(r)]
    if not clean:
        return ""
    width = max(len(r) for r in clean)
    lines = [r + [""] * (width - len(r)) for r in clean]
    return "\n".join(f"| {' | '.join(r)} |" for r in [lines[0], ["---"] * width, *lines[1:]])


def render(blocks: list[tuple]) -> str:
    """Markdown of blocks: headings of level 1 to 6, paragraphs, tables; blank ones left out."""
    parts = []
    for kind, level, text, rows in blocks:
        if kind == "heading":
            parts.append(f"{'#' * max(1, min(level, 6))} {text.strip()}")
        elif kind == "table":
            parts.append(render_table(rows))
        else:
            parts.append(text.strip())
    return "\n\n".join(p for p in parts if p).strip()


def _quality(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(F.filter(lines, lambda x: x.rlike(I.SUSPICIOUS) | (~x.rlike(I.JAVA_TABLE_RULE) & (x.rlike(I.SUSPICIOUS_SHAPE) | ((F.length(x) > 30) & (I.symbol_ratio(x) > 0.45))))))


def documents(files: DataFrame) -> DataFrame:
    """(path, method, content_hash, blocks, text, warnings, status, quality, text_chars, table_count, suspicious_lines) of (path, content).

    A file that can't be read has status failed and the reason as a warning, and the others are read on; null content counts as empty.
    PDF files are failed too, as no reader of PDF is built. Each file is one row and is read by one task.
    """

    def step(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                ext, content = os.path.splitext(path.lower())[1], content or b""
                blocks, notes, failed = [], [], False
                try:
                    if ext == ".docx":
                        blocks, notes = docx_blocks(content)
                    elif ext == ".pdf":
                        raise ValueError("PDF files are not read")
                    else:
                        text = decode(content)
                        blocks = [("paragraph", None, text.replace("\0", "�"), None)]
                        notes = [UNDECODED] if _share(text, "\0�") > NOISE else []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    failed, notes = True, [str(e)[:300]]
                rows.append((path, hashlib.sha256(content).hexdigest(), "docx" if ext == ".docx" else "markdown" if ext in (".md", ".markdown") else "pdf_text_layer" if ext == ".pdf" else "plain_text", blocks, render(blocks), notes, failed))
            frame = pd.DataFrame(rows, columns=["path", "content_hash", "method", "blocks", "text", "warnings", "failed"])
            frame["blocks"] = [[dict(zip(("type", "level", "text", "rows"), b)) for b in bs] for bs in frame["blocks"]]
            yield frame

    read = files.select("path", "content").mapInPandas(step, f"path string, content_hash string, method string, blocks array<{_BLOCK}>, text string, warnings array<string>, failed boolean")
    empty = F.length("text") == 0
    status = F.when(F.col("failed") | empty, "failed").when(F.size("warnings") > 0, "parsed_with_warnings").otherwise("indexed")
    out = read.withColumn("status", status).withColumn("suspicious_lines", _quality(F.col("text")))
    out = out.withColumn("warnings", F.when(empty & ~F.col("failed"), F.array_append("warnings", F.lit(EMPTY))).otherwise(F.col("warnings")))
    quality = F.when(F.col("status") == "failed", "unusable").when((F.size("warnings") > 0) | (F.col("suspicious_lines") > 0), "usable").otherwise("good")
    tables = F.size(F.filter("blocks", lambda b: b["type"] == "table"))
    return out.select("path", "content_hash", "method", "blocks", "text", "warnings", "status", quality.alias("quality"), F.length("text").alias("text_chars"), tables.alias("table_count"), "suspicious_lines")
