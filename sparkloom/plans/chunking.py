"""Chunks of Markdown documents. Importing this module adds its query to QUERIES and ORACLES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import chunker
from .queries import _table, query

TARGET, LIMIT = 60, 90

# A conversation as a document: a preamble, a heading, and a section for each turn with a paragraph for each line.
_CLEAN = r"regexp_replace(trim(regexp_replace(coalesce(text, ''), '[^\p{L}., \n]', '', 'g')), '\s*\n\s*', chr(10), 'g')"


@query(rf"""WITH RECURSIVE turns AS (
  SELECT 'talks/' || source || '/' || conv_id || '.md' AS path, turn, list_filter(string_split({_CLEAN}, chr(10)), lambda x: x <> '') AS b, ['Talk ' || conv_id, c.role || ' ' || turn] AS crumbs, 2 AS level
  FROM conversations c JOIN (SELECT doc_id, source FROM documents) ON doc_id = conv_id
), sections AS (
  SELECT path, turn, b, crumbs, level FROM turns UNION ALL SELECT DISTINCT path, -1, [], crumbs[1:1], 1 FROM turns
  UNION ALL SELECT DISTINCT path, -2, ['Held in ' || path || '.'], [regexp_extract(path, '([^/]*)\.md$', 1)], 1 FROM turns
), costs AS (SELECT *, list_transform(b, lambda x: CAST(ceil(length(x) / 4) AS INTEGER)) AS c, ceil(length(array_to_string(b, chr(10) || chr(10))) / 4) <= {LIMIT} AS whole FROM sections),
fill AS (
  SELECT path, turn, b, c, whole, 1 AS i, 1 AS part, c[1] AS used, c[1] > {LIMIT} AS alone FROM costs WHERE len(b) > 0
  UNION ALL SELECT path, turn, b, c, whole, i + 1, CASE WHEN NOT whole AND (alone OR c[i + 1] > {LIMIT} OR used + c[i + 1] > {TARGET}) THEN part + 1 ELSE part END,
    CASE WHEN NOT whole AND (alone OR c[i + 1] > {LIMIT} OR used + c[i + 1] > {TARGET}) THEN c[i + 1] ELSE used + c[i + 1] END, c[i + 1] > {LIMIT} FROM fill WHERE i < len(b)
), bodies AS (
  SELECT path, turn, part, string_agg(b[i], chr(10) || chr(10) ORDER BY i) AS body, bool_or(NOT whole AND alone) AS alone FROM fill GROUP BY 1, 2, 3
  UNION ALL SELECT path, turn, 1, '', false FROM costs WHERE len(b) = 0
), keyed AS (SELECT s.*, p.part, p.body, p.alone, sha256(s.path || '::' || array_to_string(crumbs, ' > ') || '::' || part)[1:16] AS stable_key, count(*) OVER (PARTITION BY s.path, s.turn) AS n FROM bodies p JOIN costs s ON s.path = p.path AND s.turn = p.turn)
SELECT path, array_to_string(crumbs, ' > ') AS breadcrumb, CAST(level AS INTEGER) AS heading_level, CAST(part AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS chunk_count, CAST(ceil(length(body) / 4) AS INTEGER) AS tokens, stable_key,
  sha256(stable_key || ':' || sha256(body))[1:16] AS version_id, regexp_replace(lower(crumbs[len(crumbs)]), '\s+', '-', 'g') AS heading_slug,
  CASE WHEN alone THEN 'Block of type ''paragraph'' exceeds max_tokens (' || CAST(ceil(length(body) / 4) AS INTEGER) || ' > {LIMIT}); kept as single chunk.' END AS warning FROM keyed""")
def document_chunks(spark, sf_dir):
    c = F.col
    talks = _table(spark, sf_dir, "conversations").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), c("conv_id") == c("doc_id"))
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}., \n]", "")), r"\s*\n\s*", "\n\n")
    part = F.concat(F.lit("## "), c("role"), F.lit(" "), c("turn").cast("string"), F.lit("\n\n"), clean)
    path = F.concat(F.lit("talks/"), c("source"), F.lit("/"), c("conv_id").cast("string"), F.lit(".md"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n\n")
    docs = talks.groupBy(path.alias("path"), "conv_id").agg(body.alias("body"))
    text = F.concat(F.lit("---\nkind: talk\n---\nHeld in "), c("path"), F.lit(".\n\n# Talk "), c("conv_id").cast("string"), F.lit("\n\n"), c("body"))
    out = chunker.chunks(docs.select("path", text.alias("text")), "path", "text", TARGET, LIMIT)
    return out.select("path", F.array_join("heading_path", " > ").alias("breadcrumb"), "heading_level", "chunk_index", "chunk_count", "tokens", "stable_key", "version_id", "heading_slug", "warning")
