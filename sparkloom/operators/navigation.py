"""Navigation trees: nested lists of pages to ordered rows, merged by precedence of origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Origins from the weakest to the strongest, and what each is trusted as.
ORIGINS = ("frontmatter", "readme_as_index", "mkdocs", "docusaurus_category", "docusaurus_sidebar", "vitepress")
TRUST = {"frontmatter": "frontmatter", "readme_as_index": "structural"}


def provenance(origin: Column) -> Column:
    out = F.lit("explicit_config")
    for name, trust in TRUST.items():
        out = F.when(origin == name, trust).otherwise(out)
    return out


def from_outline(configs: DataFrame) -> DataFrame:
    """(origin, source, label, section, depth, position) of configs (origin, text): an indented list, two spaces a level, of `- label: path` for pages and `- label:` for sections.

    Any depth: the sections open above a line are those of the last lines of each lesser depth, found by one window a config, not by walking a tree.
    """
    c = F.col
    lines = configs.select("origin", "name", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(c("line").rlike(r"^ *- "))
    depth = (F.length(F.regexp_extract("line", "^( *)", 1)) / 2).cast("int")
    body = F.regexp_replace("line", "^ *- ", "")
    label, path = F.trim(F.regexp_extract(body, "^([^:]*)", 1)), F.trim(F.regexp_extract(body, "^[^:]*:(.*)$", 1))
    rows = lines.select("origin", "name", "at", depth.alias("depth"), label.alias("label"), path.alias("path"))
    order = Window.partitionBy("origin", "name").orderBy("at")
    # The open sections after each line: those of lesser depth stay, a section of its own depth and all deeper ones end.
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    most = 8
    opened = rows
    for d in range(most):
        last_section = F.last(F.when((c("depth") == d) & (c("path") == ""), F.struct(c("at").alias("at"), c("label").alias("label"))), ignorenulls=True).over(upto)
        last_end = F.max(F.when(c("depth") < d, c("at"))).over(upto)
        opened = opened.withColumn(f"o{d}", F.when((c("depth") > d) & (F.coalesce(last_end, F.lit(-1)) < last_section["at"]), last_section["label"]))
    section = F.array_compact(F.array(*[c(f"o{d}") for d in range(most)]))
    pages = opened.where(c("path") != "").withColumn("section", F.array_join(section, "/"))
    place = F.row_number().over(Window.partitionBy("origin", "name", "section").orderBy("at"))
    return pages.select("origin", c("path").alias("source"), "label", F.when(c("section") == "", "root").otherwise(c("section")).alias("section"), "depth", place.alias("position"), F.lit(False).alias("landing"))


def merged(raw: DataFrame) -> DataFrame:
    """(source, label, section, position, landing, origin, provenance): each source's entry of the strongest origin (of one origin the first given, by position), numbered anew within its section.

    The first entry of a section that a config states is its landing page, and one that says so itself in front matter; neither where it is alone.
    """
    c = F.col
    strength = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), c("origin"))
    best = raw.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(strength), "position", "section", "label"))).where(c("__n") == 1).drop("__n")
    within = Window.partitionBy("section").orderBy("position", "source")
    many = F.count(F.lit(1)).over(Window.partitionBy("section")) > 1
    placed = best.withColumn("trust", provenance(c("origin"))).withColumn("nr", F.row_number().over(within)).withColumn("many", many)
    lands = c("many") & (((c("trust") == "explicit_config") & (c("nr") == 1)) | ((c("trust") == "frontmatter") & c("landing")))
    return placed.select("source", "label", "section", c("nr").alias("position"), lands.alias("landing"), "origin", c("trust").alias("provenance"))
