"""Positioned text to lines, cells and blocks: two levels of sessions by gaps, then runs of lines of one kind. Windows are by page, so a page is the largest unit that a task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import SUSPICIOUS, SUSPICIOUS_SHAPE

#: Parts of an item's height: how far baselines of a line lie apart, how wide a gap between cells is, how far lines of a paragraph lie apart.
LINE, CELL, PARAGRAPH = 0.5, 1.5, 1.8
#: Points between items that are a space; less is kerning.
SPACE = 1.0
SCHEDULE, PART = r"^Schedule\s+[A-Z0-9]", r"^Part\s+[IVXLC0-9]+\b"
LEADERS = r"^(.*?[^\s.])\s*(?:\.\s?+){3,}+\s*([^\s.].*)$"
#: A value of more words than this without a digit is prose.
VALUE_WORDS = 3


def lines(items: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, line, y, height, cells) of items (keys, x, y, width, height, text): lines from the top, their cells from the left. Blank items only part what is around them."""
    c, page = F.col, Window.partitionBy(*keys)
    some = items.where(F.trim("text") != "")
    before = page.orderBy("y", "x", "text")
    new = F.coalesce((c("y") - F.lag("y").over(before)) > LINE * F.greatest(c("height"), F.lag("height").over(before)), F.lit(True))
    some = some.withColumn("line", F.sum(new.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*keys, "line").orderBy("x", "y", "text")
    gap = c("x") - F.lag(c("x") + c("width")).over(across)
    some = some.withColumn("gap", gap).withColumn("cell", F.sum((F.coalesce(gap, F.lit(0.0)) > CELL * c("height")).cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.lag("cell").over(across).isNull() | (F.lag("cell").over(across) != c("cell"))
    piece = F.when(first | (c("gap") <= SPACE), F.trim("text")).otherwise(F.concat(F.lit(" "), F.trim("text")))
    said = some.withColumn("piece", piece).withColumn("place", F.row_number().over(across))
    joined = lambda col: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", col))), lambda p: p[col]), "")
    cells = said.groupBy(*keys, "line", "cell").agg(joined("piece").alias("words"), F.min("y").alias("y"), F.max("height").alias("height"))
    row = F.transform(F.sort_array(F.collect_list(F.struct("cell", "words"))), lambda p: p["words"])
    return cells.groupBy(*keys, "line").agg(F.min("y").alias("y"), F.max("height").alias("height"), row.alias("cells"))


def _prose(value: Column) -> Column:
    return (F.size(F.split(value, r"\s+")) > VALUE_WORDS) & ~value.rlike("[0-9]")


def blocks(found: DataFrame, tables: DataFrame | None = None, fields: DataFrame | None = None, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, place, kind, level, label, value, text, rows): heading, key_value, table or paragraph, in the order of each page.

    tables: (keys, nr, rows) as ruled on the page; those with two rows and two columns or more, and some text, come after the page's blocks, and lines of which they have all cells go.
    fields: (keys, label, value) of forms; each once a page, at its end.
    """
    c = F.col
    text = F.array_join("cells", " ")
    rows = found.withColumn("text", text).where(~text.rlike(SUSPICIOUS) & ~text.rlike(SUSPICIOUS_SHAPE))
    ruled = None
    if tables is not None:
        wide = F.array_max(F.transform("rows", lambda r: F.size(r)))
        ruled = tables.where((F.size("rows") >= 2) & (wide >= 2) & F.exists(F.flatten("rows"), lambda x: F.trim(x) != ""))
        known = ruled.groupBy(*[c(k).alias(f"t_{k}") for k in keys]).agg(F.flatten(F.collect_list(F.flatten("rows"))).alias("known"))
        rows = rows.join(known, [c(k) == c(f"t_{k}") for k in keys], "left").where(c("known").isNull() | F.exists("cells", lambda x: ~F.array_contains("known", x))).drop("known", *[f"t_{k}" for k in keys])
    n, first, last = F.size("cells"), F.get("cells", 0), F.get("cells", 1)
    heading = (n == 1) & ~c("text").rlike(r"\.$") & (c("text").rlike(SCHEDULE) | c("text").rlike(PART))
    leaders = (n == 1) & c("text").rlike(LEADERS)
    kind = F.when(heading, "heading").when(leaders, "key_value").when((n == 2) & ~_prose(last), "key_value").when(n >= 3, "table").when(n == 2, "columns").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    order = Window.partitionBy(*keys).orderBy("line")
    same = (F.lag("kind").over(order) == c("kind")) & ((c("kind") == "table") | ((c("kind") == "paragraph") & ((c("y") - F.lag("y").over(order)) <= PARAGRAPH * F.greatest(c("height"), F.lag("height").over(order)))))
    rows = rows.withColumn("block", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_lines = F.sort_array(F.collect_list(F.struct("line", "text", "cells")))
    out = rows.groupBy(*keys, "block", "kind").agg(sorted_lines.alias("ls"))
    lone = (c("kind") == "columns") | ((c("kind") == "table") & (F.size("ls") < 2))
    one = F.get("ls", 0)
    label = F.when(F.size(one["cells"]) == 2, F.get(one["cells"], 0)).otherwise(F.regexp_extract(one["text"], LEADERS, 1))
    value = F.when(F.size(one["cells"]) == 2, F.get(one["cells"], 1)).otherwise(F.regexp_extract(one["text"], LEADERS, 2))
    is_ = lambda k: c("kind") == k
    nothing = F.lit(None).cast("string")
    out = out.select(
        *keys, F.lit(0).alias("part"), c("block").alias("nr"), F.when(lone, "paragraph").otherwise(c("kind")).alias("kind"), F.when(is_("heading"), F.when(one["text"].rlike(SCHEDULE), 1).otherwise(2)).alias("level"),
        F.when(is_("key_value"), label).alias("label"), F.when(is_("key_value"), value).alias("value"), F.when(is_("heading") | is_("paragraph") | lone, F.array_join(F.transform("ls", lambda x: x["text"]), "\n")).alias("text"),
        F.when(is_("table") & ~lone, F.transform("ls", lambda x: x["cells"])).alias("rows"),
    )
    if ruled is not None:
        out = out.union(ruled.select(*keys, F.lit(1), c("nr").cast("bigint"), F.lit("table"), F.lit(None).cast("int"), nothing, nothing, nothing, "rows"))
    if fields is not None:
        once = fields.select(*keys, F.when(F.trim("label") == "", "Form field").otherwise(c("label")).alias("label"), "value").distinct()
        nr = F.row_number().over(Window.partitionBy(*keys).orderBy("label", "value")).cast("bigint")
        out = out.union(once.select(*keys, F.lit(2), nr, F.lit("key_value"), F.lit(None).cast("int"), "label", "value", nothing, F.lit(None).cast("array<array<string>>")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "nr"))).select(*keys, "place", "kind", "level", "label", "value", "text", "rows")
