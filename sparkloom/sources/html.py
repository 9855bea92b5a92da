"""Plain text and blocks of simple HTML, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character references that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def to_text(html: Column) -> Column:
    """Text without tags, character references decoded, white space collapsed."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for ref, char in ENTITIES:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def list_items(html: Column) -> Column:
    """array<string>: texts of the li elements, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), to_text)


def title(html: Column) -> Column:
    return to_text(F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1))
