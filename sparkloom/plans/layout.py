"""Queries about positioned text and navigation trees. Importing this module adds them to QUERIES and ORACLES.

A document is a page of positioned text: its lines lie 14 points apart, and what a comma parts are items 150 points apart. Navigation files hold the pages of 40 numbers each, in sections by language and group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import navigation, positioned
from ..sources import fences
from .queries import _table, query

PER_FILE = 40
_q = lambda s: "'" + s.replace("'", "''") + "'"
_LEADERS = _q(positioned.LEADERS.replace("?+", "?").replace("}+", "}"))
_BLOCKS = rf"""raw AS (SELECT doc_id, i - 1 AS i, unnest(string_split(line, ',')) AS seg, generate_subscripts(string_split(line, ','), 1) - 1 AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
items AS (SELECT doc_id, i, k, trim(seg) AS t, 72.0::DOUBLE + 150 * k AS x, 5.0::DOUBLE * length(trim(seg)) AS width FROM raw WHERE trim(seg) <> ''),
gaps AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, i ORDER BY k) AS gap FROM items),
celled AS (SELECT *, sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY k) AS cell FROM gaps),
words AS (SELECT doc_id, i, cell, string_agg(CASE WHEN k = first_k OR gap <= 1 THEN t ELSE ' ' || t END, '' ORDER BY k) AS w FROM (SELECT *, min(k) OVER (PARTITION BY doc_id, i, cell) AS first_k FROM celled) GROUP BY 1, 2, 3),
lines AS (SELECT doc_id, i, list(w ORDER BY cell) AS cells, string_agg(w, ' ' ORDER BY cell) AS text FROM words GROUP BY 1, 2),
kept AS (SELECT *, len(cells) AS n FROM lines WHERE NOT regexp_matches(text, {_q(I.SUSPICIOUS)}) AND NOT regexp_matches(text, {_q(I.SUSPICIOUS_SHAPE)})),
kinds AS (SELECT *, CASE WHEN n = 1 AND NOT ends_with(text, '.') AND (regexp_matches(text, {_q(positioned.SCHEDULE)}) OR regexp_matches(text, {_q(positioned.PART)})) THEN 'heading' WHEN n = 1 AND regexp_matches(text, {_LEADERS}) THEN 'key_value'
  WHEN n = 2 AND NOT (len(regexp_split_to_array(cells[2], '\s+')) > 3 AND NOT regexp_matches(cells[2], '[0-9]')) THEN 'key_value' WHEN n >= 3 THEN 'table' WHEN n = 2 THEN 'columns' ELSE 'paragraph' END AS kind FROM kept),
marked AS (SELECT *, sum(CASE WHEN lag_kind = kind AND (kind = 'table' OR (kind = 'paragraph' AND 14 * (i - lag_i) <= 18)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS block
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS lag_kind, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS lag_i FROM kinds)),
blocks AS (SELECT doc_id, block, kind, count(*) AS m, string_agg(text, chr(10) ORDER BY i) AS text, arg_min(cells, i) AS cells, arg_min(text, i) AS one, string_agg(array_to_string(cells, '|'), ';' ORDER BY i) AS rows FROM marked GROUP BY 1, 2, 3)"""


@query(f"""WITH {_BLOCKS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) AS INTEGER) AS place, CASE WHEN kind = 'columns' OR (kind = 'table' AND m < 2) THEN 'paragraph' ELSE kind END AS kind, CAST(CASE WHEN kind = 'heading' THEN CASE WHEN regexp_matches(one, {_q(positioned.SCHEDULE)}) THEN 1 ELSE 2 END END AS INTEGER) AS level,
  CASE WHEN kind = 'key_value' THEN CASE WHEN len(cells) = 2 THEN cells[1] ELSE regexp_extract(one, {_LEADERS}, 1) END END AS label, CASE WHEN kind = 'key_value' THEN CASE WHEN len(cells) = 2 THEN cells[2] ELSE regexp_extract(one, {_LEADERS}, 2) END END AS value,
  CASE WHEN kind IN ('heading', 'paragraph', 'columns') OR (kind = 'table' AND m < 2) THEN text END AS text, CASE WHEN kind = 'table' AND m >= 2 THEN rows END AS rows FROM blocks""")
def pdf_blocks(spark, sf_dir):
    c = F.col
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    parts = lines.select("doc_id", "i", F.posexplode(F.split("line", ",")).alias("k", "seg")).withColumn("text", F.trim("seg"))
    items = parts.select("doc_id", F.lit(1).alias("page"), "text", (72.0 + 150 * c("k")).alias("x"), (14.0 * c("i")).alias("y"), (5.0 * F.length("text")).alias("width"), F.lit(10.0).alias("height"))
    found = positioned.blocks(positioned.lines(items, ("doc_id", "page")), keys=("doc_id", "page"))
    return found.select("doc_id", "place", "kind", "level", "label", "value", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


_NAV = f"""raw AS (SELECT page_id, ({list(navigation.ORIGINS)})[page_id // {PER_FILE} % 6 + 1] AS origin, page_id // {PER_FILE} AS name, regexp_extract(url, '^[^:]*://[^/]*/([a-z]+)', 1) AS lang, 'p' || page_id AS label, page_id % 7 = 0 AS top, page_id % 5 = 0 AS mid FROM pages),
entries AS (SELECT *, lang || '/' || page_id % {PER_FILE} || '.md' AS source, CASE WHEN top THEN 'root' WHEN mid THEN lang ELSE lang || '/g' || page_id % 3 END AS section, CASE WHEN top THEN 0 WHEN mid THEN 1 ELSE 2 END AS depth FROM raw WHERE lang <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY origin, name, section ORDER BY page_id) AS position FROM entries)"""


@query(f"""WITH {_NAV}, best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY list_position({list(navigation.ORIGINS)}, origin) DESC, position, section, label) AS n FROM placed),
nr AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY position, source) AS k, count(*) OVER (PARTITION BY section) AS many, CASE origin WHEN 'frontmatter' THEN 'frontmatter' WHEN 'readme_as_index' THEN 'structural' ELSE 'explicit_config' END AS provenance FROM best WHERE n = 1)
SELECT source, label, section, CAST(k AS INTEGER) AS position, many > 1 AND provenance = 'explicit_config' AND k = 1 AS landing, origin, provenance FROM nr""")
def nav_entries(spark, sf_dir):
    c, i = F.col, F.col("page_id")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^:]*://[^/]*/([a-z]+)", 1).alias("lang")).where("lang <> ''")
    entry = F.concat(F.lit("- p"), i.cast("string"), F.lit(": "), c("lang"), F.lit("/"), (i % PER_FILE).cast("string"), F.lit(".md"))
    section, group = F.concat(F.lit("- "), c("lang"), F.lit(":\n")), F.concat(F.lit("  - g"), (i % 3).cast("string"), F.lit(":\n"))
    lines = F.when(i % 7 == 0, entry).when(i % 5 == 0, F.concat(section, F.lit("  "), entry)).otherwise(F.concat(section, group, F.lit("    "), entry))
    files = pages.groupBy(F.floor(i / PER_FILE).alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", lines.alias("lines")))), lambda x: x["lines"]), "\n").alias("text"))  # PER_FILE pages each
    origin = F.element_at(F.array(*[F.lit(o) for o in navigation.ORIGINS]), (c("name") % 6 + 1).cast("int"))
    return navigation.merged(navigation.from_outline(files.select(origin.alias("origin"), "name", "text")))


_WORDS = "(SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, lower(regexp_extract(line, '[A-Za-z]{3,}')) AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)) WHERE w <> '')"


@query(f"""WITH f AS {_WORDS}, e AS (
  SELECT doc_id, n, 'import' AS kind, '@org/' || w || '/sub' AS value, 1 AS place FROM f WHERE i % 4 = 0 UNION ALL SELECT doc_id, n, 'package_name', '@org/' || w, 1 FROM f WHERE i % 4 = 0
  UNION ALL SELECT doc_id, n, 'symbol', w, 1 FROM f WHERE i % 4 = 0 UNION ALL SELECT doc_id, n, 'symbol', w || '_x', 2 FROM f WHERE i % 4 = 0 UNION ALL SELECT doc_id, n, 'route', '/v1/' || w, 1 FROM f WHERE i % 8 = 0
  UNION ALL SELECT doc_id, n, 'config_file', w || '.config.ts', 1 FROM f WHERE i % 4 = 0 UNION ALL SELECT doc_id, n, 'cli_command', 'npm', 1 FROM f WHERE i % 4 = 1 UNION ALL SELECT doc_id, n, 'package_name', w, 1 FROM f WHERE i % 4 = 1
  UNION ALL SELECT doc_id, n, 'config_key', unnest([w, 'in_' || w, 'k-' || w]), unnest([1, 2, 3]) FROM f WHERE i % 4 = 2 UNION ALL SELECT doc_id, n, 'config_key', unnest([w, 'sub_' || w]), unnest([1, 2]) FROM f WHERE i % 4 = 3)
SELECT e.doc_id, CAST(e.n AS INTEGER) AS fence, CASE WHEN f.i % 8 = 0 THEN 'The api of it' ELSE 'Notes' END AS section, kind, value, CAST(place AS INTEGER) AS place FROM e JOIN f USING (doc_id, n)""")
def fence_entities(spark, sf_dir):
    """Each line with a word is a section with a code fence in one of four languages that names the word."""
    c, w, i = F.col, F.col("w"), F.col("i")
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    words = lines.select("doc_id", "i", F.lower(F.regexp_extract("line", "[A-Za-z]{3,}", 0)).alias("w")).where("w <> ''")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    script = say("```ts\nimport { ", w, " as ", w, "_x } from '@org/", w, "/sub';\nfetch(\"/v1/", w, "\"); fetch(\"/v1/", w, ".json\");\n// see ", w, ".config.ts\n```")
    shell = say("```bash\n$ npm install -D ", w, "@1.2\n# npm add no\n```")
    tree = say("```jsonc\n{\"", w, "\": {\"in_", w, "\": [{\"k-", w, "\": 1},]}} // end\n```")
    yaml = say("```yaml\n", w, ": # note: no\n  sub_", w, ": 1\n```")
    block = say("## ", F.when(i % 8 == 0, "The api of it").otherwise("Notes"), "\n\n", F.when(i % 4 == 0, script).when(i % 4 == 1, shell).when(i % 4 == 2, tree).otherwise(yaml))
    docs = words.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))  # the lines of one document
    found = fences.entities(docs.select(c("doc_id").cast("string").alias("path"), "text"))
    return found.select(c("path").cast("bigint").alias("doc_id"), "fence", "section", "kind", "value", "place")
