"""Queries about profiles, re-ranking, selection and adjudication. Importing this module adds them to QUERIES and ORACLES.

Documents become Markdown: lines of at most HEADING characters are headings, of a level by their number of words, the others paragraphs. Paths take a folder of a kind of document. Tasks are the items of benchmark, put as
questions of several kinds; their candidates are the first sources that BM25 gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions import text as T
from ..functions.scoring import rounded
from ..operators import rerank
from ..sources import profiles
from ..sources.scratch import written
from .queries import _ALL_RANKED, _ranked, _table, query, sql_tokens

HEADING, TOP = 44, 30
FOLDERS = ("docs/guide", "docs/api", "docs/adr", "packages/onwh", "docs/concepts", "examples", "docs/v2/ref", "archive")
NAMES = ("", "index", "README", "changelog", "overview", "migration-notes", "", "")
PREFIXES = ("", "why was it decided that ", "what is ", "how does it work: upgrade to v2 of ", "explain the overview of ", "fix src/app/main.ts in ")


def _clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[^\p{L}0-9 ]", ""))


def markdown(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, lines, text): each document as Markdown, or those whose doc_id is in only, its lines cleaned of marks."""
    c = F.col
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _clean), lambda x: x != "")
    docs = _table(spark, sf_dir, "documents")
    docs = (docs if only is None else docs.join(only, "doc_id", "left_semi")).select("doc_id", lines.alias("lines"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    eighth = F.floor(c("doc_id") / 8)
    slug = F.concat(T.slugify(F.array_join(F.slice(F.split(F.coalesce(F.get("lines", 0), F.lit("none")), " "), 1, 3), " ")), F.lit("-"), c("doc_id").cast("string"))
    name = F.when(pick(NAMES, eighth) != "", pick(NAMES, eighth)).otherwise(slug)
    path = F.concat(pick(FOLDERS, c("doc_id")), F.lit("/"), F.floor(c("doc_id") / 64).cast("string"), F.lit("/"), name, F.lit(".md"))
    marks = F.array(*[F.lit("#" * k + " ") for k in (1, 2, 3)])
    level = lambda x: F.size(F.split(x, " ")) % 3
    block = lambda x, i: F.when(F.length(x) <= HEADING, F.concat(F.element_at(marks, F.when(i == 0, 1).otherwise(level(x) + 1)), x)).otherwise(x)
    return docs.select("doc_id", path.alias("path"), "lines", F.array_join(F.transform("lines", block), "\n\n").alias("text"))


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}0-9 ]', '', 'g'))), lambda x: x <> '')"
_PICK = lambda values, at="doc_id": f"({list(values)})[{at} % {len(values)} + 1]"
_SLUG = "regexp_replace(regexp_replace(lower(array_to_string(string_split(coalesce(lines[1], 'none'), ' ')[1:3], ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || doc_id"
_NAME = f"CASE WHEN {_PICK(NAMES, 'doc_id // 8')} <> '' THEN {_PICK(NAMES, 'doc_id // 8')} ELSE {_SLUG} END"
_PATH = f"{_PICK(FOLDERS)} || '/' || CAST(doc_id // 64 AS VARCHAR) || '/' || {_NAME} || '.md'"
_LEVEL = "CASE WHEN i = 1 THEN 1 ELSE len(string_split(x, ' ')) % 3 + 1 END"
_PURPOSE = r"""CASE WHEN regexp_matches(lower(path), '(^|/)docs/adr/') THEN 'adr' WHEN stem = 'changelog' THEN 'changelog' WHEN regexp_matches(stem, 'migrat|upgrad') THEN 'migration'
  WHEN stem = 'readme' AND regexp_matches(lower(path), '(^|/)packages?/') THEN 'package_readme' WHEN stem = 'readme' THEN 'readme' WHEN regexp_matches(lower(path), '(^|/)examples?/') THEN 'example'
  WHEN regexp_matches(lower(path), '(^|/)docs/api/') THEN 'api_reference' WHEN regexp_matches(lower(path), '(^|/)docs/concepts?/') THEN 'concept' WHEN regexp_matches(lower(path), '(^|/)docs/guides?/') THEN 'guide'
  WHEN regexp_matches(lower(title), '\bmigration\b|\bupgrad') THEN 'migration' WHEN regexp_matches(lower(title), '\bchangelog\b') THEN 'changelog' WHEN regexp_matches(lower(title), '\breference\b') THEN 'api_reference'
  WHEN regexp_matches(lower(title), '\bquick ?start\b|\bgetting started\b') THEN 'quick_start' WHEN regexp_matches(lower(title), '\bguide\b|\bhow ?to\b') THEN 'guide'
  WHEN len(list_filter(outline, lambda h: regexp_matches(lower(h.x), '\b(class|interface|function|method|api)\b'))) >= 3 THEN 'api_reference' ELSE 'unknown' END"""
_PROFILES = rf"""lined AS (SELECT doc_id, {_LINES} AS lines FROM documents),
pathed AS (SELECT doc_id, lines, {_PATH} AS path FROM lined),
parts AS (SELECT doc_id, path, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM pathed),
leveled AS (SELECT *, length(x) <= {HEADING} AS heading, CASE WHEN length(x) <= {HEADING} THEN {_LEVEL} END AS level FROM parts),
outlined AS (SELECT doc_id, coalesce(list({{'level': level, 'x': x, 'i': i}} ORDER BY i) FILTER (heading), []) AS outline, min(i) FILTER (heading) AS first_heading, min(i) FILTER (NOT heading) AS first_text FROM leveled GROUP BY 1),
intros AS (SELECT o.doc_id, arg_min(x, i) FILTER (NOT heading AND (first_heading IS NULL OR i > first_heading)) AS intro FROM outlined o JOIN leveled USING (doc_id) GROUP BY 1),
titled AS (
  SELECT p.doc_id, path, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '')) AS stem, coalesce(outline, []) AS outline, intro, list_filter(coalesce(outline, []), lambda h: h.level = 1)[1].x AS h1,
    coalesce(list_filter(coalesce(outline, []), lambda h: h.level = 1)[1].x, nullif(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', ''), ''), regexp_extract(path, '[^/]*$')) AS title, lines
  FROM pathed p LEFT JOIN outlined USING (doc_id) LEFT JOIN intros USING (doc_id)
), raw_aliases AS (
  SELECT doc_id, unnest([{{'k': 'path', 'v': regexp_replace(path, '\.[^.]+$', ''), 'o': 0}}] || list_transform(list_filter(string_split(regexp_replace(path, '\.[^.]+$', ''), '/'), lambda s: s <> '' AND s <> 'docs'), lambda s, j: {{'k': 'path', 'v': s, 'o': j}})
    || [{{'k': 'filename', 'v': regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', ''), 'o': 100}}, {{'k': 'title', 'v': title, 'o': 101}}]
    || CASE WHEN h1 IS NOT NULL AND h1 <> title THEN [{{'k': 'title', 'v': h1, 'o': 102}}] ELSE [] END
    || list_transform(list_filter(outline, lambda h: h.level BETWEEN 2 AND 3), lambda h: {{'k': 'heading', 'v': h.x, 'o': 1000 + h.i}})
    || CASE WHEN regexp_extract(path, '(?i)(?:^|/)packages/([^/]+)/README\.md$', 1) <> '' THEN [{{'k': 'package', 'v': regexp_extract(path, '(?i)(?:^|/)packages/([^/]+)/README\.md$', 1), 'o': 100000000}}] ELSE [] END) AS a FROM titled
), kept_aliases AS (SELECT doc_id, a.k AS k, arg_min(a.v, a.o) AS v, min(a.o) AS o FROM raw_aliases WHERE trim(a.v) <> '' GROUP BY doc_id, a.k, lower(trim(a.v))),
aliased AS (SELECT doc_id, list({{'k': k, 'v': v}} ORDER BY o) AS aliases FROM kept_aliases GROUP BY 1),
profiled AS (
  SELECT t.*, aliases, {_PURPOSE} AS purpose, nullif(regexp_extract(path, '(?:^|/)packages?/([^/]+)/', 1), '') AS package_segment, list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^v?[0-9]+(\.[0-9x]+)*$'))[1] AS version_segment,
    CASE WHEN path LIKE 'archive/%' THEN 'archive' ELSE 'canonical' END AS role, len(lines)::BIGINT AS chunk_count, CAST(ceil(length(array_to_string(lines, '')) / 4) AS BIGINT) AS token_count
  FROM titled t JOIN aliased USING (doc_id)
)"""


def profiled(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    docs = markdown(spark, sf_dir, only)
    found = profiles.source_profiles(docs.select("path", "text")).drop("token_count")
    sized = docs.select("doc_id", F.col("path").alias("p"), F.size("lines").cast("bigint").alias("chunk_count"), F.ceil(F.length(F.array_join("lines", "")) / 4).cast("bigint").alias("token_count"))
    return found.join(sized, F.col("path") == F.col("p")).drop("p").withColumn("role", F.when(F.col("path").startswith("archive/"), "archive").otherwise("canonical"))


@query(rf"""WITH {_PROFILES}
SELECT path, title, h1, intro, CASE WHEN length(coalesce(h1, title) || chr(10) || chr(10) || intro) <= 480 THEN coalesce(h1, title) || chr(10) || chr(10) || intro ELSE rtrim(substring(coalesce(h1, title) || chr(10) || chr(10) || intro, 1, 479)) || '…' END AS summary,
  purpose, package_segment, version_segment, array_to_string(list_transform(aliases, lambda a: a.k || ':' || a.v), ';') AS aliases,
  array_to_string(list_transform(list_filter(outline, lambda h: regexp_matches(lower(h.x), '^(how|why|what|when|where|which|can|should|do|does|is|are)\s')), lambda h: h.x), ';') AS questions,
  array_to_string(list_transform(outline, lambda h: h.level || ' ' || h.x), ';') AS outline FROM profiled""")
def source_profiles(spark, sf_dir):
    text = lambda col, f, by=";": F.array_join(F.transform(col, f), by)
    return profiled(spark, sf_dir).select(
        "path", "title", "h1", "intro", "summary", "purpose", "package_segment", "version_segment", text("aliases", lambda a: F.concat(a["kind"], F.lit(":"), a["value"])).alias("aliases"),
        F.array_join("questions", ";").alias("questions"), text("outline", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["text"])).alias("outline"),
    )


@query(rf"""WITH {_PROFILES}, heads AS (SELECT doc_id, path, unnest(outline) AS h FROM titled),
above AS (SELECT a.doc_id, a.h.i AS i, b.h.x AS x, b.h.i AS nr FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.h.i < a.h.i AND b.h.level < a.h.level
  AND NOT EXISTS (SELECT 1 FROM heads z WHERE z.doc_id = a.doc_id AND z.h.i > b.h.i AND z.h.i < a.h.i AND z.h.level <= b.h.level)),
sections AS (SELECT doc_id, i, string_agg(x, ' > ' ORDER BY nr) AS section FROM above GROUP BY 1, 2)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY h.i) AS INTEGER) AS place, h.x AS surface, trim(regexp_replace(lower(h.x), '\s+', ' ', 'g')) AS normalized, CAST(h.level AS INTEGER) AS depth, coalesce(section, '') AS section
FROM heads LEFT JOIN sections ON sections.doc_id = heads.doc_id AND sections.i = h.i""")
def heading_aliases(spark, sf_dir):
    found = profiled(spark, sf_dir).select("path", F.posexplode("heading_aliases").alias("at", "a"))
    return found.select("path", (F.col("at") + 1).alias("place"), "a.surface", "a.normalized", "a.depth", F.array_join("a.section_path", " > ").alias("section"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text, tokens, intent): the items as questions."""
    i = F.col("item_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (i % len(PREFIXES) + 1).cast("int"))
    text = F.concat(prefix, F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "benchmark").select("item_id", text.alias("task")).select("item_id", "task", T.tokenize(F.col("task")).alias("tokens"), identifiers.query_intent(F.col("task")).alias("intent"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sources of each task with their profiles, as the re-ranking takes them. Only these sources are profiled; they are written first, as two steps read them."""
    c = F.col
    top = written(_ranked(spark, sf_dir, TOP), "top").select("item_id", "doc_id", c("score").alias("chunk_score"), c("rank").alias("chunk_rank"))
    known = profiled(spark, sf_dir, top.select("doc_id").distinct()).withColumn("headings", F.transform("outline", lambda h: h["text"])).drop("outline", "summary", "questions", "slugs", "title_tokens", "heading_aliases")
    return top.join(known, "doc_id").join(tasks(spark, sf_dir), "item_id").withColumn("fused_rank", F.lit(None).cast("int")).withColumnRenamed("path", "source")


def _names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _whole(col: str) -> str:
    """The tokenizer without splitting identifiers."""
    raw = f"list_transform(list_filter(regexp_split_to_array(coalesce({col}, ''), '{_SEP}'), lambda x: x <> ''), lambda x: lower(x))"
    clean = f"list_transform(list_filter({raw}, lambda x: length(x) > 1), lambda x: regexp_replace(x, '[^a-z0-9_]', '', 'g'))"
    return f"list_filter({clean}, lambda x: length(x) > 1 AND x NOT IN ({_names(T.STOP_WORDS)}))"


_SEP = T.SEPARATORS.replace("'", "''")
_CLASS = lambda t: "CASE " + " ".join(f"WHEN {t} IN ({_names(k)}) THEN '{k[0]}'" for k in rerank.CLASSES) + f" ELSE {t} END"
_EQUAL = lambda t: "CASE " + " ".join(f"WHEN {t} IN ({_names(k)}) THEN {list(k)}" for k in rerank.CLASSES) + f" ELSE [{t}] END"
_ANY = lambda col, names: f"len(list_filter({col}, lambda t: t IN ({_names(names)}))) > 0"
_INTENT = (
    f"CASE WHEN NOT regexp_matches(task, '[A-Za-z0-9]') THEN 'signal_empty' WHEN regexp_matches(task, '{identifiers.FILE_PATH}') THEN 'file_anchored' WHEN regexp_matches(task, '{identifiers.DECISION}') THEN 'decision_lookup' "
    f"WHEN regexp_matches(task, '{identifiers.SYMBOL}') THEN 'exact_symbol' ELSE 'broad_domain' END"
)
_FIT = "CASE " + " ".join(f"WHEN intent = '{k}' AND purpose = '{p}' THEN {w}" for k, t in rerank.PURPOSE_FITS.items() for p, w in t.items()) + " ELSE 0.0 END"
_OWN = lambda s: f"coalesce(max(cover) FILTER (s = '{s}'), 0.0) AS own_{s}, coalesce(max(best) FILTER (s = '{s}'), 0.0) AS strong_{s}"
_COVER = lambda col: f"CASE WHEN len(tokens) > 0 THEN CAST(len(list_filter(tokens, lambda t: list_contains({col}, t))) AS DOUBLE) / len(tokens) ELSE 0.0 END"
_VALUES = lambda kinds: "array_to_string(list_transform(" + (f"list_filter(aliases, lambda a: a.k IN ({_names(kinds)}))" if kinds else "aliases") + ", lambda a: a.v), chr(10))"
_MIGRATION = rerank.MIGRATION.replace("'", "''")
_SEGMENT = lambda s: f"({s} IS NOT NULL AND len(list_intersect([lower({s})] || list_filter(regexp_split_to_array(lower({s}), '[-_.]+'), lambda p: p <> '') || flatten(list_transform(list_filter(regexp_split_to_array(lower({s}), '[-_.]+'), lambda p: p <> ''), lambda p: {sql_tokens('p')})), tokens)) > 0)"
_MODEL = f"""r_tasks AS (SELECT item_id, {_PICK(PREFIXES, 'item_id')} || coalesce(text, '') AS task FROM benchmark),
r_asked AS (SELECT item_id, task, {sql_tokens('task')} AS tokens, {_INTENT} AS intent FROM r_tasks),
r_every AS (SELECT *, list_distinct(flatten(list_transform(tokens, lambda t: {_EQUAL('t')}))) AS eq FROM r_asked),
r_own AS (SELECT *, CASE WHEN len(list_filter(eq, lambda t: t NOT IN ({_names(rerank.NOISE)}))) > 0 THEN list_filter(eq, lambda t: t NOT IN ({_names(rerank.NOISE)})) ELSE eq END AS own FROM r_every),
r_cand AS (
  SELECT item_id, p.*, p.path AS src, score AS chunk_score, rank AS chunk_rank, r_own.tokens, intent, own, array_to_string(list_transform(outline, lambda h: h.x), chr(10)) AS heads FROM ranked JOIN profiled p USING (doc_id) JOIN r_own USING (item_id) WHERE rank <= {TOP}
), r_doc AS (SELECT DISTINCT doc_id, path, title, h1, intro, aliases, heads FROM r_cand),
r_surf AS (
  SELECT doc_id, 'title' AS s, unnest({_whole('title')}) AS token FROM r_doc UNION ALL SELECT doc_id, 'path', unnest({_whole('path')}) FROM r_doc
  UNION ALL SELECT doc_id, 'file', unnest({_whole("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')")}) FROM r_doc UNION ALL SELECT doc_id, 'heading', unnest({_whole('heads')}) FROM r_doc
  UNION ALL SELECT doc_id, 'intro', unnest({_whole('intro')}) FROM r_doc UNION ALL SELECT doc_id, 'alias', unnest({_whole(_VALUES(rerank.IDENTITY))}) FROM r_doc
  UNION ALL SELECT doc_id, 'h1', unnest({_whole('h1')}) FROM r_doc UNION ALL SELECT doc_id, 'all', unnest({_whole(_VALUES(()))}) FROM r_doc
), r_owns AS (SELECT item_id, unnest(own) AS token, len(own) AS n_own FROM r_own),
r_ask_parts AS (SELECT DISTINCT token, {_CLASS('token')} AS class, unnest({_EQUAL('token')}) AS part FROM r_owns),
r_known AS (SELECT DISTINCT token FROM r_surf), r_known_parts AS (SELECT token, {_CLASS('token')} AS class, unnest({_EQUAL('token')}) AS whole FROM r_known),
r_forms AS (
  SELECT DISTINCT a.token, k.token AS form FROM r_ask_parts a JOIN r_known_parts k ON a.class = k.class
  UNION SELECT DISTINCT a.token, k.token FROM r_ask_parts a JOIN r_known_parts k ON length(a.part) >= 5 AND length(k.whole) >= length(a.part) + 3 AND contains(k.whole, a.part)
), r_met AS (SELECT DISTINCT c.item_id, c.doc_id, s.s, o.token FROM r_cand c JOIN r_owns o ON o.item_id = c.item_id JOIN r_forms f ON f.token = o.token JOIN r_surf s ON s.doc_id = c.doc_id AND s.token = f.form),
r_n AS (SELECT item_id, count(*) AS n FROM r_cand GROUP BY 1), r_df AS (SELECT item_id, token, count(DISTINCT doc_id) AS df FROM r_met WHERE s <> 'alias' GROUP BY 1, 2),
r_weights AS (SELECT o.item_id, o.token, n_own, greatest(0.18, least(1.0, CASE WHEN df IS NULL THEN 0.55 ELSE 0.20 + ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) / ln(n + 1.0::DOUBLE) END)) AS w FROM r_owns o JOIN r_n USING (item_id) LEFT JOIN r_df USING (item_id, token)),
r_cover AS (SELECT item_id, doc_id, s, sum(w) / any_value(n_own) AS cover, max(w) AS best FROM r_met JOIN r_weights USING (item_id, token) GROUP BY 1, 2, 3),
r_surfaces AS (SELECT item_id, doc_id, {", ".join(_OWN(s) for s in rerank.SURFACES)} FROM r_cover GROUP BY 1, 2),
r_split AS (
  SELECT c.*, {sql_tokens('c.title')} AS title_split, {sql_tokens('c.path')} AS path_split, {sql_tokens('c.heads')} AS heading_split, {sql_tokens(_VALUES(()))} AS alias_split, {sql_tokens("regexp_replace(regexp_extract(c.path, '[^/]*$'), '[.][^.]+$', '')")} AS leaf_split,
    {_whole('c.title')} AS title_whole, {_whole("regexp_replace(regexp_extract(c.path, '[^/]*$'), '[.][^.]+$', '')")} AS file_whole, {_whole("regexp_extract(c.path, '([^/]+)/+[^/]*$', 1)")} AS parent_whole,
    {", ".join(f"coalesce(own_{s}, 0.0) AS own_{s}, coalesce(strong_{s}, 0.0) AS strong_{s}" for s in rerank.SURFACES)}
  FROM r_cand c LEFT JOIN r_surfaces USING (item_id, doc_id)
), r_a AS (
  SELECT *, {_COVER('title_split')} AS in_title, {_COVER('path_split')} AS in_path, {_COVER('heading_split')} AS in_heading, 1 / sqrt(greatest(chunk_rank, 1)) AS rank_prior,
    least(len(list_filter(tokens, lambda t: list_contains(alias_split, t))), 4) AS alias_hits, greatest(own_title, own_path, own_heading, own_intro, own_alias) AS topic,
    CAST(own_file >= 0.2 AS INTEGER) + CAST(own_title >= 0.2 AS INTEGER) + CAST(own_path >= 0.2 AS INTEGER) + CAST(own_alias >= 0.2 AS INTEGER) AS names, CAST(own_heading >= 0.2 AS INTEGER) + CAST(own_intro >= 0.2 AS INTEGER) AS backs,
    greatest(own_file, own_title, own_path, own_alias) AS named, greatest(own_heading, own_intro) AS backed,
    regexp_matches(array_to_string(tokens, ' '), '{_MIGRATION}') OR (list_contains(tokens, 'move') AND len(list_filter(tokens, lambda t: regexp_matches(t, '(?i)^v?[0-9]+([.][0-9]+)*$'))) > 0) AS moves,
    {_ANY('leaf_split', rerank.BROAD_NAMES)} OR {_ANY('title_split', rerank.BROAD_NAMES)} AS broad,
    {_ANY('tokens', rerank.OVERVIEW_ASKED)} OR (list_contains(tokens, 'how') AND list_contains(tokens, 'work')) OR (list_contains(tokens, 'what') AND len(own) <= 1) AS asks_overview,
    stem IN ({_names(rerank.LANDINGS)}) OR {_ANY('title_whole', rerank.OVERVIEW_NAMES)} OR {_ANY('parent_whole', rerank.OVERVIEW_NAMES)} AS landing FROM r_split
), r_b AS (
  SELECT *, greatest(0.0, least(1.0, greatest(own_file, own_title * 0.9, own_path * 0.78, own_alias * 0.72, greatest(strong_file, strong_title * 0.9, strong_path * 0.75) * 0.82) + greatest(own_heading * 0.22, own_intro * 0.25)
      + CASE WHEN names >= 2 THEN 0.10 ELSE 0.0 END + CASE WHEN names >= 1 AND backs >= 1 THEN 0.08 ELSE 0.0 END + CASE WHEN intent = 'file_anchored' AND own_file > 0 AND names >= 2 THEN 0.10 ELSE 0.0 END)) AS owner,
    CASE WHEN asks_overview AND landing AND topic > 0 THEN greatest(0.0, least(1.0, 0.52 + topic * 0.35 + CASE WHEN stem IN ('overview', 'readme') THEN 0.10 ELSE 0.0 END + CASE WHEN len(own) <= 1 THEN 0.10 ELSE 0.0 END)) ELSE 0.0 END AS overview,
    CASE WHEN moves AND purpose IN ({_names(rerank.RELEASES)}) THEN greatest({_FIT}, 0.30) ELSE {_FIT} END AS purpose_fit,
    CASE WHEN purpose IN ({_names(rerank.RELEASES)}) AND NOT moves THEN -0.20 ELSE 0.0 END - CASE WHEN purpose = 'api_reference' AND intent = 'decision_lookup' THEN 0.10 ELSE 0.0 END AS astray,
    backed >= 0.20 AND named < 0.15 AS by_heads,
    CASE WHEN intent IN ('broad_domain', 'decision_lookup') AND stem NOT IN ({_names(rerank.LANDINGS)}) AND greatest(strong_file, strong_title) <= 0 AND own_path >= 0.20 AND greatest(own_title, own_file) < 0.35
      AND len(list_filter(title_whole || file_whole, lambda t: t NOT IN ({_names(rerank.NOISE)}) AND NOT list_contains(list_transform(own, lambda o: {_CLASS('o')}), {_CLASS('t')}))) > 0 THEN -0.10 ELSE 0.0 END AS narrow,
    CASE WHEN role = 'archive' THEN -0.15 ELSE 0.0 END AS role_cost, CASE WHEN {_SEGMENT('package_segment')} THEN 0.30 ELSE 0.0 END + CASE WHEN {_SEGMENT('version_segment')} THEN 0.30 ELSE 0.0 END AS topology FROM r_a
), r_c AS (
  SELECT *, CASE WHEN overview <= 0.5 THEN greatest(-0.42, CASE WHEN by_heads AND (token_count >= 2500 OR chunk_count >= 15) THEN CASE WHEN intent = 'file_anchored' THEN -0.22 ELSE -0.15 END ELSE 0.0 END + CASE WHEN by_heads AND broad THEN -0.12 ELSE 0.0 END
    + CASE WHEN purpose = 'api_reference' AND intent IN ('broad_domain', 'file_anchored') AND named < 0.35 THEN -0.10 ELSE 0.0 END + CASE WHEN broad AND named < 0.20 AND backed > 0 THEN -0.08 ELSE 0.0 END) ELSE 0.0 END AS container FROM r_b
), r_model AS (
  SELECT *, chunk_score * 0.62 + rank_prior * 0.08 + in_title * 0.28 + in_path * 0.30 + least(in_title, in_path) * 0.20 + in_heading * 0.05 + own_file * 0.18 + own_intro * 0.05 + alias_hits * 0.025 + owner * 0.72 + overview * 0.65 + purpose_fit * 0.35
    + astray + container + narrow + role_cost + topology AS model_score FROM r_c
), r_order AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY chunk_rank, src) AS k,
  CASE WHEN regexp_extract(src, '(?i)^(.*/)(?:index|README)[.](?:md|mdx)$', 1) <> '' THEN regexp_extract(src, '(?i)^(.*/)(?:index|README)[.](?:md|mdx)$', 1) ELSE regexp_extract(src, '(?i)^(.+)[.](?:md|mdx)$', 1) || '/' END AS dir FROM r_model),
r_kids AS (SELECT a.item_id, a.k, list(b.k) AS kids FROM r_order a JOIN r_order b ON a.item_id = b.item_id AND a.src <> b.src AND starts_with(b.src, a.dir) GROUP BY 1, 2),
r_lists AS (SELECT item_id, any_value(intent) AS intent, list(model_score ORDER BY o.k) AS scores, list(coalesce(kids, []) ORDER BY o.k) AS kids FROM r_order o LEFT JOIN r_kids USING (item_id, k) GROUP BY 1),
r_fold AS (
  SELECT item_id, intent, kids, scores, 1 AS k FROM r_lists
  UNION ALL SELECT item_id, intent, kids, list_transform(scores, lambda s, j: CASE WHEN j = k AND intent <> 'signal_empty' AND coalesce(list_max(list_transform(kids[k], lambda x: scores[x])), 0) > 0 AND least(scores[k], list_max(list_transform(kids[k], lambda x: scores[x]))) > 0
      THEN s + 0.15 * least(scores[k], list_max(list_transform(kids[k], lambda x: scores[x]))) ELSE s END), k + 1 FROM r_fold WHERE k <= len(scores)
), r_final AS (SELECT o.*, f.scores[o.k] AS final, row_number() OVER (PARTITION BY o.item_id ORDER BY round(f.scores[o.k], 9) DESC, chunk_rank, src) AS rerank_rank FROM r_order o JOIN r_fold f ON f.item_id = o.item_id AND f.k = len(f.scores) + 1)"""


@query(f"""WITH RECURSIVE {_ALL_RANKED}, {_PROFILES}, {_MODEL}
SELECT item_id, src AS source, intent, round(in_title, 6) AS in_title, round(in_path, 6) AS in_path, round(in_heading, 6) AS in_heading, round(own_file, 6) AS own_file, round(owner, 6) AS owner, round(overview, 6) AS overview, purpose_fit, round(astray, 6) AS astray,
  round(container, 6) AS container, narrow, role_cost, topology, round(model_score, 6) AS model_score, round(final, 6) AS score, CAST(rerank_rank AS INTEGER) AS rerank_rank FROM r_final""")
def source_rerank(spark, sf_dir):
    c, out = F.col, rerank.reranked(candidates(spark, sf_dir), "item_id")
    six = lambda n: rounded(c(n), 6).alias(n)
    return out.select("item_id", "source", "intent", *map(six, ("in_title", "in_path", "in_heading", "own_file", "owner", "overview")), "purpose_fit", *map(six, ("astray", "container")), "narrow", "role_cost", "topology", *map(six, ("model_score", "score")), "rerank_rank")
