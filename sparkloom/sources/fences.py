"""What the code fences of Markdown documents name: imports, packages, symbols, routes, configuration files and keys, commands. Python cuts the fences and walks JSON; the rest are column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunker import blocks, front_matter

# Languages of fences, and the patterns of what they name.
SCRIPTS = ("ts", "tsx", "js", "jsx", "typescript", "javascript", "mjs", "cjs", "mts", "cts")
SHELLS = ("sh", "bash", "shell", "zsh", "console", "shellscript")
JSONS, YAMLS = ("json", "jsonc", "json5"), ("yaml", "yml")
IMPORTS = (r"""\bfrom\s+["']([^"']+)["']""", r"""(?m)^\s*import\s+["']([^"']+)["']\s*;?""", r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)""")
NAMED_IMPORT = r"""\bimport\s*[^{}'"`]*\{([^}]+)\}\s*from\s*["'][^"']+["']"""
SYMBOLS = (
    r"""\bimport\s+([A-Za-z_]\w*)(?:\s*,\s*(?:\*\s+as\s+\w+|\{[^}]*\}))?\s+from\s+["'][^"']+["']""", r"""\bimport\s*\*\s+as\s+([A-Za-z_]\w*)\s+from\s+["'][^"']+["']""",
    r"\bexport\s+(?:async\s+)?function\s+(\w+)", r"\bexport\s+(?:abstract\s+)?class\s+(\w+)", r"\bexport\s+interface\s+(\w+)", r"\bexport\s+type\s+(\w+)", r"\bexport\s+(?:const|let|var)\s+([A-Za-z_]\w*)",
    r"\bexport\s+default\s+(?:async\s+)?(?:function|class)\s+([A-Za-z_]\w*)", r"\bexport\s+(?:const\s+)?enum\s+(\w+)",
)
CONFIG_SHAPE = r"\bdefineConfig\s*\(|\bexport\s+default\s*\{|\bmodule\.exports\s*=\s*\{"
CONFIG_KEY = r"""(?:^|[\s,{])([A-Za-z_]\w*)\s*:\s*(?:\{|\[|"|'|`|\d|true|false|null|new\s+|function|\(|defineConfig|async)"""
CONFIG_FILES = (
    r"\b([\w.-]+\.config\.(?:ts|tsx|mts|cts|js|mjs|cjs|json|yaml|yml))\b", r"\b(tsconfig(?:\.[\w-]+)?\.json)\b", r"\b(package(?:-lock)?\.json)\b",
    r"\b(\.?(?:eslintrc|prettierrc|babelrc)(?:\.[\w-]+)?(?:\.json|\.yaml|\.yml|\.js|\.cjs|\.mjs)?)\b",
)
ROUTE_HEADING = r"(?i)\b(http|api|route|routes|endpoint|endpoints|rest|webhook|handler)\b"
ROUTE, NO_ROUTE, ROUTE_PART = r"""["'`](/[^"'`\s]*)["'`]""", r"(?i)\.(?:ts|tsx|js|mjs|cjs|jsx|json|yaml|yml|md|mdx|html|css|svg|png|jpg|jpeg|gif|webp|ico|map)$", r"/[A-Za-z0-9_:{}-]"
INSTALL = r"(?im)^[ \t]*(?:\$\s*)?(?:npm|pnpm|yarn|bun|npx|pnpx)\s+(?:install|add|i)\b([^\n]*)"
YAML_KEY, LOOSE_KEY = r"(?m)^[ \t]*([A-Za-z_][\w-]*)[ \t]*:", r'"([\w.-]+)"\s*:'


def json_keys(code: str) -> list[str]:
    """All keys at any depth, in order; of what is no JSON, even without comments and trailing commas, what looks like keys."""
    bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)(^|[^:])//.*$", r"\1", re.sub(r"/\*[\s\S]*?\*/", "", code)))
    for text in (code, bare):
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, (dict, list)) and value:
            out, todo = [], [value]
            while todo:
                now = todo.pop()
                if isinstance(now, tuple):
                    out.append(now[0])
                    now = now[1]
                if isinstance(now, dict):
                    todo.extend(reversed(list(now.items())))
                elif isinstance(now, list):
                    todo.extend(reversed(now))
            return out
    return re.findall(LOOSE_KEY, code)


def fences(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, fence, language, section, code, keys): the code fences of each document in order, under their nearest heading; keys are those of JSON."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, body in zip(pdf["path"], pdf["text"]):
                lines = (body or "").split("\n")
                section, n = None, 0
                for block in blocks(lines, front_matter(lines)[0]):
                    if block.kind == "heading":
                        section = block.text or section
                    elif block.kind == "code" and (opening := re.match(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)", lines[block.first])):
                        n += 1
                        closed = block.last > block.first and lines[block.last].strip().startswith(opening[1][0] * 3)
                        code = "\n".join(lines[block.first + 1 : block.last + (0 if closed else 1)])
                        language = opening[2].lower()
                        rows.append((name, n, language, section, code, json_keys(code) if language in JSONS else []))
            yield pd.DataFrame(rows, columns=["path", "fence", "language", "section", "code", "keys"])

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(step, "path string, fence int, language string, section string, code string, keys array<string>")


def _all(patterns: tuple[str, ...], code: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in patterns])


def package_of(spec: Column) -> Column:
    """The package of an import: with its scope, without what is inside it."""
    return F.when(F.startswith(spec, F.lit("@")), F.array_join(F.slice(F.split(spec, "/"), 1, 2), "/")).otherwise(F.substring_index(spec, "/", 1))


def entities(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, fence, language, section, kind, value, place): each value once for its fence and kind; place is its order among the fence's values of the kind.

    Defined cases: fences of other languages, and null or empty documents, name nothing; configuration files are told apart without letter case.
    """
    c = F.col
    code = F.col("code")
    script, shell = c("language").isin(*SCRIPTS), c("language").isin(*SHELLS)
    none = F.array().cast("array<string>")
    imports = F.array_distinct(_all(IMPORTS, code))
    outside = F.filter(imports, lambda s: ~F.startswith(s, F.lit(".")) & ~F.startswith(s, F.lit("/")))
    inside = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(NAMED_IMPORT), F.lit(1)), lambda x: F.split(x, ",")))
    pieces = F.transform(inside, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    named = F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(r"^\w+ as \w+$"), F.split(p, " as ")).when(p.rlike(r"^[A-Za-z_]\w*$"), F.array(p)).otherwise(none)))
    routes = F.filter(F.regexp_extract_all(code, F.lit(ROUTE), F.lit(1)), lambda v: ~v.rlike(NO_ROUTE) & v.rlike(ROUTE_PART))
    lines = F.transform(F.split(code, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^[$>%]\s+", "")))
    first = F.transform(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), lambda x: F.get(F.split(x, r"\s+"), 0))
    commands = F.filter(first, lambda t: ~F.contains(t, F.lit("=")) & t.rlike("^[a-z][a-z0-9._-]+$"))
    operands = F.filter(F.flatten(F.transform(F.regexp_extract_all(code, F.lit(INSTALL), F.lit(1)), lambda x: F.split(x, r"\s+"))), lambda t: (t != "") & ~F.startswith(t, F.lit("-")))
    bare = F.transform(operands, lambda t: F.when(F.startswith(t, F.lit("@")), F.concat(F.lit("@"), F.substring_index(F.substring(t, 2, 1 << 30), "@", 1))).otherwise(F.substring_index(t, "@", 1)))
    installed = F.filter(bare, lambda p: (F.length(p) >= 2) & p.rlike(r"^[@\w][\w/.@~-]*$"))
    yaml = F.regexp_extract_all(F.regexp_replace(code, "(?m)#.*$", ""), F.lit(YAML_KEY), F.lit(1))
    config = F.when(script & code.rlike(CONFIG_SHAPE), F.regexp_extract_all(code, F.lit(CONFIG_KEY), F.lit(1))).when(c("language").isin(*YAMLS), yaml).otherwise(c("keys"))
    files = F.when(script | shell, _all(CONFIG_FILES, code)).otherwise(none)
    low = F.transform(files, F.lower)
    kinds = {
        "import": F.when(script, imports).otherwise(none), "package_name": F.when(script, F.transform(outside, package_of)).when(shell, installed).otherwise(none),
        "symbol": F.when(script, F.concat(named, _all(SYMBOLS, code))).otherwise(none), "config_key": config, "route": F.when(script & c("section").rlike(ROUTE_HEADING), routes).otherwise(none),
        "cli_command": F.when(shell, commands).otherwise(none), "config_file": F.filter(files, lambda f, i: F.array_position(low, F.lower(f)) == i + 1),
    }
    told = F.array(*[F.struct(F.lit(k).alias("kind"), F.filter(F.array_distinct(v), lambda x: F.trim(x) != "").alias("values")) for k, v in kinds.items()])
    each = fences(docs, path, text).select("path", "fence", "language", "section", F.explode(told).alias("t"))
    return each.select("path", "fence", "language", "section", "t.kind", F.posexplode("t.values").alias("place", "value")).withColumn("place", F.col("place") + 1)
