"""Identifier-shaped tokens, sentences that state rules, and layout risk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, and the patterns that tell identifiers from prose.
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
)
RUN = r"[A-Za-z0-9#/\\._-]+"
SHAPE = r"^[A-Za-z0-9][A-Za-z0-9#/-]*[A-Za-z0-9]$"
UNSEPARATED = r"^[A-Z]{3,}[0-9]{2,}[A-Z0-9]*$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]"
PROSE_YEAR = r"^[a-z]+-(?:19|20)[0-9]{2}$"
QUANTITY = r"^[0-9]+([-/#][A-Za-z]+)+$"
# Words of a rule, and openings that are noise.
STRONG = r"(?i)\b(must not|must|never|always|cannot|do not)\b"
WEAK = r"(?i)\b(should not|should)\b"
GLOSSARY = r"^[A-Z][^:]+:\s+[^()]+\s+\(do not translate"
BOT_PREFIXES = ("👷", "📝", "🐛", "✨", "♻️", "➖", "📌", "🔥", "⬆️", "⚡", "🚀")

_MONTH = "(?:" + "|".join(MONTHS) + ")"
MONTH_DATE = f"(?i)^(?:(?:[0-9]+|{_MONTH})[-/#])+(?:[0-9]+|{_MONTH})$"
MONTH_SEGMENT = f"(?i)(?:^|[-/#]){_MONTH}(?:$|[-/#])"


def is_id(token: Column) -> Column:
    dated = token.rlike(MONTH_DATE) & token.rlike(MONTH_SEGMENT)
    separated = token.rlike("[-/#]") | token.rlike(UNSEPARATED)
    prose = token.rlike(ISO_TIME) | token.rlike(PROSE_YEAR) | token.rlike(QUANTITY) | dated
    return F.length(token).between(5, 40) & token.rlike(SHAPE) & token.rlike("[A-Za-z]") & token.rlike("[0-9][^0-9]*[0-9]") & separated & ~prose


def id_tokens(text: Column) -> Column:
    """array<string>: identifiers in order of appearance, the first spelling of each."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0)), lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))
    found = F.filter(runs, is_id)
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)


def sentences(text: Column) -> Column:
    """Candidate sentences of 20 to 240 characters, without list marks."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\n"), "\n+")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[-*]\s+", ""), r"^[0-9]+\.\s+", "")))
    return F.filter(plain, lambda s: F.length(s).between(20, 240))


def is_rule(sentence: Column) -> Column:
    noise = sentence.rlike(GLOSSARY)
    for p in BOT_PREFIXES:
        noise = noise | sentence.startswith(p)
    return (sentence.rlike(STRONG) | sentence.rlike(WEAK)) & ~noise


def rule_key(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


# Lines that tell of a bad extraction, and the table rule that doesn't.
TABLE_RULE = r"^\|(?:\s*:?-{3,}:?\s*\|)+$"
JAVA_TABLE_RULE = TABLE_RULE.replace(")+", ")++")
SUSPICIOUS = r"(?i)--\s*[0-9]+\s+of\s+[0-9]+\s*--|^Docusign Envelope ID:"
SUSPICIOUS_SHAPE = r"^[\s~{}_|=\-]{8,}$|[{}]{6,}|^[0-9]{1,3}$"
CAPS = r"^[A-Z0-9][A-Z0-9 /&().,'-]{2,}$"
ISOLATED = r"^[A-Z]?[0-9]{1,4}[A-Z]?$"


def symbol_ratio(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[A-Za-z0-9\s]", "")) / F.length(line)


def layout_risk(text: Column) -> Column:
    """Sum of the shares of short, symbol-heavy, upper-case, number and suspicious lines; 0 without lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    odd = lambda x: ~x.rlike(JAVA_TABLE_RULE) | x.rlike(SUSPICIOUS)
    bad = lambda x: odd(x) & (x.rlike(SUSPICIOUS) | x.rlike(SUSPICIOUS_SHAPE) | ((F.length(x) > 30) & (symbol_ratio(x) > 0.45)))
    marks = lambda x: (
        (F.length(x) <= 18).cast("int") + (symbol_ratio(x) > 0.35).cast("int") + (x.rlike(CAPS) & (F.length(x) <= 80)).cast("int")
        + x.rlike(ISOLATED).cast("int") + bad(x).cast("int")
    )
    total = F.aggregate(lines, F.lit(0), lambda n, x: n + marks(x))
    return F.when(F.size(lines) > 0, total / F.size(lines)).otherwise(F.lit(0.0))


def normalized_file(path: Column) -> Column:
    """Lower case, forward slashes, without the usual leading folders, each dropped once in this order."""
    out = F.regexp_replace(F.translate(F.lower(path), "\\", "/"), r"^\./", "")
    for p in ("src/", "lib/", "tests/", "test/", "spec/", "specs/", "docs/", "doc/"):
        out = F.regexp_replace(out, f"^{p}", "")
    return out


# What makes a task a question about a decision, or names a symbol.
DECISION = r"(?i)\b(why|tradeoff|trade-off|rationale|decision|decisions|chose|prefer|prefers|alternative)\b"
SYMBOL = r"[a-z][A-Z]|[A-Za-z]+\.[A-Za-z]+|[A-Za-z]+\(\)"
FILE_PATH = r"\b((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+)\b"
#: The same, but each run of letters is tried once: a match from within it means one from its start.
JAVA_SYMBOL = r"[a-z][A-Z]|(?<![A-Za-z])[A-Za-z]++(?:\.[A-Za-z]|\(\))"
#: Java takes a step of recursion for each repetition of a group that it may give back, so here a path has at most FOLDERS folders at once; a longer one is found in parts.
FOLDERS = 256
#: The first place of a run of these characters where a word may begin: a match from any later one begins there too, so each run is tried once.
RUN_START = r"(?<![A-Za-z0-9_.-])[.-]*+"
JAVA_FILE_PATH = FILE_PATH.replace("/)+", f"/){{1,{FOLDERS}}}").replace(r"\b(", RUN_START + "(", 1)


def query_intent(task: Column) -> Column:
    task = F.coalesce(task, F.lit(""))
    return (
        F.when(~task.rlike("[A-Za-z0-9]"), "signal_empty").when(task.rlike(JAVA_FILE_PATH), "file_anchored").when(task.rlike(DECISION), "decision_lookup")
        .when(task.rlike(JAVA_SYMBOL), "exact_symbol").otherwise("broad_domain")
    )
