"""Mentions in texts, what kind of document a path and title name, and what a task needs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import identifiers as I

# Patterns of mentions.
FILE_PATH = I.FILE_PATH
TEST_FILE = r"\b([A-Za-z0-9_.-]+(?:\.test\.ts|\.spec\.ts|_test\.py))\b"
SYMBOL_CHAIN = r"\b([A-Z][A-Za-z0-9]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b"
SYMBOL_BARE = r"^([A-Z][A-Za-z0-9]*)$"
ROUTE = r"(\/[A-Za-z0-9_\-]+(?:\/[A-Za-z0-9_\-:]+){0,})"
ROUTE_METHOD = r"^((?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+\/[^\s]+)$"
ENV_VAR = r"\b([A-Z][A-Z0-9_]{3,})\b"
TEST_ENDINGS = (".test.ts", ".spec.ts", "_test.py")
CODE_SPAN = r"`([^`\n]+)`"
PLACEHOLDER_SYMBOL = "^Xxx"
#: The same without groups that Java may give back, as it recurses for each of their repetitions.
JAVA_ROUTE = ROUTE.replace("){0,})", ")*+)")
JAVA_TEST_FILE = TEST_FILE.replace(r"\b(", I.RUN_START + "(", 1)
JAVA_SYMBOL_CHAIN = SYMBOL_CHAIN.replace("_]*)+)", "_]*+)++)")
CONFIDENCE = ("low", "medium", "high")

# What a path, a file name, a title and headings say about a document's purpose, the first that fits.
PURPOSE_BY_PATH = (
    ("adr", "path", r"(^|/)docs/adr/"),
    ("prd", "path", r"(^|/)docs/prd/"),
    ("runbook", "path", r"(^|/)docs/runbooks?/"),
    ("changelog", "file", r"^changelog$"),
    ("release_note", "file", r"(^|-|_)release[-_]?notes?$"),
    ("migration", "file", r"migrat|upgrad"),
    ("quick_start", "file", r"^quick[-_]?start$|getting[-_]?started"),
    ("package_readme", "both", r"(^|/)packages?/"),
    ("readme", "file", r"^readme$"),
    ("example", "path", r"(^|/)examples?/"),
    ("example", "file", r"\.example$"),
    ("api_reference", "path", r"(^|/)docs/api/|(^|/)api[-_]?reference\b"),
    ("concept", "path", r"(^|/)docs/concepts?/"),
    ("guide", "path", r"(^|/)docs/guides?/|(^|/)docs/howtos?/"),
)
PURPOSE_BY_TITLE = (
    ("migration", r"\bmigration\b|\bupgrad"),
    ("changelog", r"\bchangelog\b"),
    ("api_reference", r"\bapi reference\b|\breference\b"),
    ("quick_start", r"\bquick ?start\b|\bgetting started\b"),
    ("guide", r"\bguide\b|\bhow ?to\b"),
)
API_HEADING = r"(?i)\b(class|interface|function|method|api)\b"
API_HEADINGS = 3

# What a task's text says about its needs.
NEEDS = {
    "overview_orientation": r"(?i)\boverview\b|\bintroduction\b|\bwhat is\b|\bhow does\b|\bwhat are\b|\bexplain\b",
    "setup_install": r"(?i)\binstall(?:ation|ing)?\b|\bset(?:\s|-)?up\b|\bgetting started\b|\bconfigure\b|\bconfiguration\b|\binitiali[sz]e\b|\bbootstrap\b",
    "decision_rationale": r"(?i)\bwhy\b|\brationale\b|\btrade[- ]?off(?:s)?\b|\bdecision\b|\bdecide\b|\bchose\b|\bchoice\b|\bversus\b|\bvs\.?\b",
    "sibling_support": r"(?i)\bcompare\b|\bcomparison\b|\bversus\b|\bvs\.?\b|\bdifference between\b|\balternatives?\b",
}


def _mention(kind: str, value: Column, confidence: str, source: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(CONFIDENCE.index(confidence)).alias("rank"), F.lit(source).alias("source"))


_EMPTY = "array<struct<kind:string,value:string,rank:int,source:string>>"


def _of_span(span: Column) -> Column:
    """What a code span mentions: the first of tests, routes, a file, a symbol."""
    one = lambda *a: F.array(_mention(*a)).cast(_EMPTY)
    tests = F.regexp_extract_all(span, F.lit(JAVA_TEST_FILE), F.lit(1))
    nested = F.size(F.filter(F.split(span, "/"), lambda s: s != "")) >= 2
    is_route = span.rlike(ROUTE_METHOD) | (F.startswith(span, F.lit("/")) & (F.contains(span, F.lit(":")) | nested) & span.rlike(JAVA_ROUTE))
    is_file = F.get(F.regexp_extract_all(span, F.lit(I.JAVA_FILE_PATH), F.lit(1)), F.lit(0)) == span
    return (
        F.when(F.size(tests) > 0, F.transform(tests, lambda v: _mention("test", v, "high", "code_span")).cast(_EMPTY))
        .when(is_route, one("route", span, "high", "code_span")).when(is_file, one("file", span, "high", "explicit_path"))
        .when(span.rlike("^" + JAVA_SYMBOL_CHAIN.strip("\\b") + "$"), one("symbol", span, "high", "exact_symbol"))
        .when(span.rlike(SYMBOL_BARE) & ~span.rlike(PLACEHOLDER_SYMBOL), one("symbol", span, "medium", "exact_symbol"))
        .otherwise(F.array().cast(_EMPTY))
    )


def mentions(text: Column) -> Column:
    """array<struct<kind, value, rank, source>> of all mentions, repeats included: those of code spans first, then of the prose around them."""
    text = F.coalesce(text, F.lit(""))
    spans = F.transform(F.regexp_extract_all(text, F.lit(CODE_SPAN), F.lit(1)), lambda s: F.trim(s))
    prose = F.regexp_replace(text, CODE_SPAN, "  ")
    found = lambda p: F.regexp_extract_all(prose, F.lit(p), F.lit(1))
    is_test = lambda v: F.endswith(v, F.lit(TEST_ENDINGS[0])) | F.endswith(v, F.lit(TEST_ENDINGS[1])) | F.endswith(v, F.lit(TEST_ENDINGS[2]))
    parts = [
        F.transform(found(JAVA_TEST_FILE), lambda v: _mention("test", v, "high", "code_span")),
        F.transform(F.filter(found(I.JAVA_FILE_PATH), lambda v: ~is_test(v)), lambda v: _mention("file", v, "medium", "explicit_path")),
        F.transform(found(JAVA_SYMBOL_CHAIN), lambda v: _mention("symbol", v, "low", "bare_identifier")),
        F.transform(F.filter(found(ENV_VAR), lambda v: F.contains(v, F.lit("_"))), lambda v: _mention("env_var", v, "medium", "bare_identifier")),
        F.transform(I.id_tokens(text), lambda v: _mention("id", v, "medium", "bare_identifier")),
    ]
    return F.concat(F.flatten(F.transform(spans, _of_span)), *[p.cast(_EMPTY) for p in parts])


def purpose(path: Column, title: Column, api_headings: Column | None = None, stated: Column | None = None) -> Column:
    """Struct (purpose, by): stated in the document, else by path, file name, title, headings."""
    low = F.lower(path)
    file = F.regexp_replace(F.substring_index(F.translate(low, "\\", "/"), "/", -1), r"\.[^.]+$", "")
    say = lambda name, by: F.struct((F.lit(name) if isinstance(name, str) else name).alias("purpose"), F.lit(by).alias("by"))
    out = None
    if stated is not None:
        out = F.when(stated.isNotNull(), say(stated, "frontmatter"))
    for name, what, pattern in PURPOSE_BY_PATH:
        hit = low.rlike(pattern) if what == "path" else file.rlike(pattern) if what == "file" else (file == "readme") & low.rlike(pattern)
        out = F.when(hit, say(name, "path_rule")) if out is None else out.when(hit, say(name, "path_rule"))
    for name, pattern in PURPOSE_BY_TITLE:
        out = out.when(F.lower(title).rlike(pattern), say(name, "title_rule"))
    if api_headings is not None:
        out = out.when(api_headings >= API_HEADINGS, say("api_reference", "content_rule"))
    return out.otherwise(say("unknown", "default"))


def task_needs(task: Column, intent: Column, mode: Column, symbols: Column, directories: Column) -> Column:
    """array<string> in a fixed order. symbols: how many are given; directories: how many top directories the given files are in."""
    says = {k: task.rlike(p) for k, p in NEEDS.items()}
    broad = (intent == "broad_domain") & (mode == "unanchored")
    rules = [
        ("exact_symbol_behavior", (intent == "exact_symbol") | (symbols > 0)),
        ("overview_orientation", (intent != "exact_symbol") & (says["overview_orientation"] | broad)),
        ("setup_install", says["setup_install"]),
        ("decision_rationale", (intent == "decision_lookup") | says["decision_rationale"]),
        ("cross_module_boundary", (intent == "cross_module") | (directories >= 2)),
        ("sibling_support", says["sibling_support"]),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
