"""Mentions, anchors, document purpose, task needs, neighbours, integrity and re-indexing. Importing this module adds the queries to QUERIES and ORACLES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mentions as M
from ..functions import text as T
from ..operators import changes
from .queries import _PATH, _table, query, sql_tokens
from .scores import _CARDS, cards


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")


# A page's path and number in a text that mentions files, tests, routes, symbols, variables and numbers.
_BODY = "concat('`', p, '.md` and `GET /v1/items/', n, '` with `Client', n % 7, '.run` or `Pool', n % 5, '`, see ', p, '/a', n % 9, '.ts, not x', n % 4, '_test.py; Box.item', n % 3, ' needs MAX_RETRY_', n % 6, ', HTTP and INV-', 1000 + n % 50, '-', n % 8 + 10, ' as `/v2/a:b`')"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    num = lambda m: (n % m).cast("string")
    lit = F.lit
    body = F.concat(
        lit("`"), _path(), lit(".md` and `GET /v1/items/"), n.cast("string"), lit("` with `Client"), num(7), lit(".run` or `Pool"), num(5), lit("`, see "), _path(), lit("/a"), num(9),
        lit(".ts, not x"), num(4), lit("_test.py; Box.item"), num(3), lit(" needs MAX_RETRY_"), num(6), lit(", HTTP and INV-"), (1000 + n % 50).cast("string"), lit("-"), (n % 8 + 10).cast("string"),
        lit(" as `/v2/a:b`"),
    )
    return _table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


_TEST_END = "(\\.test\\.ts|\\.spec\\.ts|_test\\.py)$"
_MENTIONS = f"""body AS (SELECT page_id, {_BODY} AS b FROM (SELECT page_id, page_id AS n, {_PATH} AS p FROM pages)),
split AS (SELECT page_id, list_transform(regexp_extract_all(b, {_q(M.CODE_SPAN)}, 1), lambda x: trim(x)) AS spans, regexp_replace(b, {_q(M.CODE_SPAN)}, '  ', 'g') AS prose, b FROM body),
span AS (SELECT page_id, unnest(spans) AS s FROM split),
raw AS (
  SELECT page_id, 'route' AS kind, s AS value, 2 AS rank FROM span WHERE regexp_matches(s, {_q(M.ROUTE_METHOD)}) OR s LIKE '/%'
  UNION ALL SELECT page_id, 'file', s, 2 FROM span WHERE NOT regexp_matches(s, {_q(M.ROUTE_METHOD)}) AND regexp_extract(s, {_q(M.FILE_PATH)}) = s AND s NOT LIKE '/%'
  UNION ALL SELECT page_id, 'symbol', s, 2 FROM span WHERE regexp_full_match(s, '[A-Z][A-Za-z0-9]*(\\.[A-Za-z_][A-Za-z0-9_]*)+')
  UNION ALL SELECT page_id, 'symbol', s, 1 FROM span WHERE regexp_matches(s, {_q(M.SYMBOL_BARE)})
  UNION ALL SELECT page_id, 'test', unnest(regexp_extract_all(prose, {_q(M.TEST_FILE)}, 1)), 2 FROM split
  UNION ALL SELECT page_id, 'file', unnest(list_filter(regexp_extract_all(prose, {_q(M.FILE_PATH)}, 1), lambda x: NOT regexp_matches(x, '{_TEST_END}'))), 1 FROM split
  UNION ALL SELECT page_id, 'symbol', unnest(regexp_extract_all(prose, {_q(M.SYMBOL_CHAIN)}, 1)), 0 FROM split
  UNION ALL SELECT page_id, 'env_var', unnest(list_filter(regexp_extract_all(prose, {_q(M.ENV_VAR)}, 1), lambda x: contains(x, '_'))), 1 FROM split
  UNION ALL SELECT page_id, 'id', unnest(regexp_extract_all(b, 'INV-[0-9]+-[0-9]+')), 1 FROM split
), merged AS (SELECT page_id, kind, value, max(rank) AS rank FROM raw GROUP BY 1, 2, 3)"""


def merged_mentions(bodies: DataFrame) -> DataFrame:
    """(page_id, kind, value, rank): each mention once, with its highest confidence."""
    every = bodies.select("page_id", F.explode(M.mentions(F.col("body"))).alias("m")).select("page_id", "m.kind", "m.value", "m.rank")
    return every.groupBy("page_id", "kind", "value").agg(F.max("rank").alias("rank"))


@query(f"WITH {_MENTIONS} SELECT page_id, kind, value, CASE rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM merged")
def mention_merge(spark, sf_dir):
    out = merged_mentions(_bodies(spark, sf_dir))
    return out.select("page_id", "kind", "value", F.when(F.col("rank") == 2, "high").when(F.col("rank") == 1, "medium").otherwise("low").alias("confidence"))


_SEGMENTS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_ASKED = f"""asked AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'id' ELSE 'symbol' END AS kind,
  CASE page_id % 6 WHEN 0 THEN 'inv-' || (1000 + page_id % 50) || '-' || (page_id % 8 + 10) WHEN 3 THEN 'INV-' || (1000 + page_id % 50) || '-' || (page_id % 8 + 10) WHEN 1 THEN 'Pool' || (page_id % 5) WHEN 2 THEN 'client' || (page_id % 7) || '.RUN'
    WHEN 4 THEN 'Cli' ELSE 'it' END AS asked FROM pages)"""
_MATCHED = f"""{_MENTIONS}, {_ASKED}, matched AS (
  SELECT a.kind, asked, page_id, value, CASE WHEN asked = value THEN 'exact' WHEN lower(asked) = lower(value) THEN 'case_insensitive' ELSE 'symbol_form_variant' END AS how,
    CASE WHEN asked = value OR a.kind = 'id' THEN rank ELSE 0 END AS rank
  FROM asked a JOIN merged m ON a.kind = m.kind AND (lower(asked) = lower(value) OR a.kind = 'symbol' AND len({_SEGMENTS.format("asked")}) = 1 AND length({_SEGMENTS.format("asked")}[1]) >= 3
    AND len(list_filter({_SEGMENTS.format("value")}, lambda s: starts_with(s, {_SEGMENTS.format("asked")}[1]))) > 0)
)"""


def match_anchors(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """(kind, asked, page_id, value, how, rank): anchors that an asked value binds to: by itself, in another case, or, for a symbol
    of one segment with three characters or more, as the beginning of a segment.

    Equi-joins throughout: both sides by the lower-cased value, and the beginnings of segments of anchors by an asked segment.
    """
    segments = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda s: s != "")
    asked = asked.select("kind", "asked", F.lower("asked").alias("low"), segments(F.col("asked")).alias("parts"))
    own = anchors.select(F.col("kind").alias("k"), "page_id", "value", "rank")
    whole = asked.join(own.withColumn("v", F.lower("value")), (F.col("kind") == F.col("k")) & (F.col("low") == F.col("v"))).where(F.col("kind").isin("id", "symbol") | (F.col("asked") == F.col("value")))
    single = asked.where((F.col("kind") == "symbol") & (F.size("parts") == 1)).select("kind", "asked", "low", F.get("parts", F.lit(0)).alias("part")).where(F.length("part") >= 3)
    begin = F.flatten(F.transform(segments(F.col("value")), lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.substring(s, F.lit(1), n))))
    begins = own.where("k = 'symbol'").withColumn("b", F.explode(F.array_distinct(begin))).where(F.length("b") >= 3)
    variant = single.join(begins, F.col("part") == F.col("b")).where(F.col("low") != F.lower("value"))
    how = F.when(F.col("asked") == F.col("value"), "exact").when(F.col("low") == F.lower("value"), "case_insensitive").otherwise("symbol_form_variant")
    rank = F.when((F.col("asked") == F.col("value")) | (F.col("kind") == "id"), F.col("rank")).otherwise(0)
    cols = ["kind", "asked", "page_id", "value", "low", "rank"]
    return whole.select(*cols).union(variant.select(*cols)).select("kind", "asked", "page_id", "value", how.alias("how"), rank.alias("rank"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    number = F.concat((1000 + n % 50).cast("string"), F.lit("-"), (n % 8 + 10).cast("string"))
    value = (
        F.when(n % 6 == 0, F.concat(F.lit("inv-"), number)).when(n % 6 == 3, F.concat(F.lit("INV-"), number)).when(n % 6 == 1, F.concat(F.lit("Pool"), (n % 5).cast("string")))
        .when(n % 6 == 2, F.concat(F.lit("client"), (n % 7).cast("string"), F.lit(".RUN"))).when(n % 6 == 4, "Cli").otherwise("it")
    )
    return _table(spark, sf_dir, "pages").select(F.when(n % 3 == 0, "id").otherwise("symbol").alias("kind"), value.alias("asked")).distinct()


@query(f"WITH {_MATCHED} SELECT kind, asked, page_id, value, how, CAST(rank AS INTEGER) AS rank FROM matched")
def anchor_match(spark, sf_dir):
    return match_anchors(_asked(spark, sf_dir), merged_mentions(_bodies(spark, sf_dir)))


@query(f"WITH {_MATCHED} SELECT kind, asked, count(DISTINCT page_id) AS sources, count(DISTINCT page_id) <= 3 AS discriminating FROM matched GROUP BY 1, 2")
def discriminating_ids(spark, sf_dir):
    """Whether an asked value binds to so few sources that it tells them apart."""
    found = match_anchors(_asked(spark, sf_dir), merged_mentions(_bodies(spark, sf_dir)))
    return found.groupBy("kind", "asked").agg(F.count_distinct("page_id").alias("sources")).withColumn("discriminating", F.col("sources") <= 3)


_FOLDERS = ("docs/adr/", "docs/prd/", "docs/runbook/", "docs/api/", "docs/guides/", "docs/howto/", "packages/x/", "examples/", "docs/concept/", "notes/", "docs/api-reference/")
_FILES = ("changelog", "v2-release-notes", "migrating", "quick_start", "readme", "setup.example", "intro", "part", "getting-started")
_TITLES = ("Upgrading the pool", "The API reference", "How to wait", "Plain words", "A changelog", "Quickstart here", "Notes")


def _pick(col: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (col % len(values) + 1).cast("int"))


def _sql_pick(col: str, values: tuple[str, ...]) -> str:
    return f"[{', '.join(map(_q, values))}][{col} % {len(values)} + 1]"


_PURPOSE = " ".join(
    f"WHEN {'regexp_matches(lower(path), ' + _q(p) + ')' if w == 'path' else 'regexp_matches(file, ' + _q(p) + ')' if w == 'file' else 'file = ' + _q('readme') + ' AND regexp_matches(lower(path), ' + _q(p) + ')'} THEN '{n}|path_rule'"
    for n, w, p in M.PURPOSE_BY_PATH
) + " " + " ".join(f"WHEN regexp_matches(lower(title), {_q(p)}) THEN '{n}|title_rule'" for n, p in M.PURPOSE_BY_TITLE)


@query(f"""WITH d AS (SELECT doc_id, {_sql_pick("doc_id", _FOLDERS)} || {_sql_pick("n_chars", _FILES)} || '.md' AS path, {_sql_pick("(doc_id + n_chars)", _TITLES)} AS title, CASE WHEN doc_id % 17 = 0 THEN 'concept' END AS stated, n_chars % 5 AS api FROM documents),
f AS (SELECT *, regexp_replace(list_last(string_split(lower(path), '/')), '\\.[^.]+$', '') AS file FROM d),
p AS (SELECT *, CASE WHEN stated IS NOT NULL THEN stated || '|frontmatter' {_PURPOSE} WHEN api >= 3 THEN 'api_reference|content_rule' ELSE 'unknown|default' END AS x FROM f)
SELECT doc_id, path, split_part(x, '|', 1) AS purpose, split_part(x, '|', 2) AS purpose_by,
  CASE WHEN doc_id % 13 = 0 THEN 'archive' WHEN regexp_matches(path, '^(?:.*/)?examples/.*$') THEN 'example' WHEN regexp_matches(path, '^notes/.*$') THEN 'ideation' ELSE 'canonical' END AS role FROM p""")
def doc_purpose(spark, sf_dir):
    from ..functions import paths as P

    d = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(_pick(d, _FOLDERS), _pick(F.col("n_chars"), _FILES), F.lit(".md")).alias("path"), _pick(d + F.col("n_chars"), _TITLES).alias("title"),
        F.when(d % 17 == 0, "concept").alias("stated"), (F.col("n_chars") % 5).alias("api"), F.when(d % 13 == 0, "archive").alias("own_role"),
    )
    role = F.coalesce("own_role", P.first_match(F.col("path"), [("**/examples/**", "example"), ("notes/**", "ideation")], F.lit("canonical")))
    said = docs.select("*", M.purpose(F.col("path"), F.col("title"), F.col("api"), F.col("stated")).alias("p"))
    return said.select("doc_id", "path", F.col("p.purpose").alias("purpose"), F.col("p.by").alias("purpose_by"), role.alias("role"))


_OPENERS = ("Why did we", "How to set up", "Compare and explain", "What is", "Fix", "Configure or", "the difference between", "decide on")
_INTENTS = ("broad_domain", "exact_symbol", "decision_lookup", "cross_module", "file_anchored")


@query(f"""WITH t AS (SELECT conv_id, turn, {_sql_pick("(conv_id + turn)", _OPENERS)} || ' ' || text AS task, {_sql_pick("conv_id", _INTENTS)} AS intent, CASE WHEN turn % 2 = 0 THEN 'unanchored' ELSE 'anchored' END AS mode, conv_id % 2 AS symbols, turn % 3 AS dirs FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN intent = 'exact_symbol' OR symbols > 0 THEN 'exact_symbol_behavior' END,
  CASE WHEN intent <> 'exact_symbol' AND (regexp_matches(task, {_q(M.NEEDS["overview_orientation"])}) OR intent = 'broad_domain' AND mode = 'unanchored') THEN 'overview_orientation' END,
  CASE WHEN regexp_matches(task, {_q(M.NEEDS["setup_install"])}) THEN 'setup_install' END,
  CASE WHEN intent = 'decision_lookup' OR regexp_matches(task, {_q(M.NEEDS["decision_rationale"])}) THEN 'decision_rationale' END,
  CASE WHEN intent = 'cross_module' OR dirs >= 2 THEN 'cross_module_boundary' END,
  CASE WHEN regexp_matches(task, {_q(M.NEEDS["sibling_support"])}) THEN 'sibling_support' END], lambda x: x IS NOT NULL), ',') AS needs FROM t""")
def task_needs(spark, sf_dir):
    c = F.col
    t = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(_pick(c("conv_id") + c("turn"), _OPENERS), F.lit(" "), "text").alias("task"), _pick(c("conv_id"), _INTENTS).alias("intent"),
        F.when(c("turn") % 2 == 0, "unanchored").otherwise("anchored").alias("mode"), (c("conv_id") % 2).alias("symbols"), (c("turn") % 3).alias("dirs"),
    )
    return t.select("conv_id", "turn", F.array_join(M.task_needs(c("task"), c("intent"), c("mode"), c("symbols"), c("dirs")), ",").alias("needs"))


# Turns as sections: every third turn is a section of the first level, those after it are its parts.
_SECTIONS = f"sections AS (SELECT conv_id AS source, turn AS id, CASE WHEN turn % 3 = 0 THEN [turn] ELSE [turn - turn % 3, turn] END AS heading_path, list_distinct(list_filter({sql_tokens('text')}, lambda x: length(x) >= 3)) AS words FROM conversations)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn")
    words = F.array_distinct(F.filter(T.tokenize(F.col("text")), lambda x: F.length(x) >= 3))
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), n.alias("id"), F.when(n % 3 == 0, F.array(n)).otherwise(F.array(n - n % 3, n)).alias("heading_path"), words.alias("words"))


@query(f"WITH {_SECTIONS} SELECT a.source, a.id, b.id AS parent FROM sections a JOIN sections b ON a.source = b.source AND len(a.heading_path) > 1 AND b.heading_path = a.heading_path[1:len(a.heading_path) - 1]")
def parent_section(spark, sf_dir):
    own = _sections(spark, sf_dir).where(F.size("heading_path") > 1)
    above = _sections(spark, sf_dir).select(F.col("source").alias("s"), F.col("id").alias("parent"), F.col("heading_path").alias("h"))
    return own.join(above, (F.col("source") == F.col("s")) & (F.slice("heading_path", F.lit(1), F.size("heading_path") - 1) == F.col("h"))).select("source", "id", "parent")


@query(f"""WITH {_SECTIONS}, pairs AS (
  SELECT a.source, a.id, b.id AS sibling, len(list_intersect(a.words, b.words)) / greatest(1, len(list_distinct(list_concat(a.words, b.words)))) AS lexical, CASE WHEN abs(a.id - b.id) <= 1 THEN 0.2 ELSE 0 END AS near
  FROM sections a JOIN sections b ON a.source = b.source AND a.id <> b.id AND len(a.heading_path) = len(b.heading_path) AND a.heading_path[1:len(a.heading_path) - 1] = b.heading_path[1:len(b.heading_path) - 1]
), scored AS (SELECT *, round(CAST(lexical AS DOUBLE) + CAST(near AS DOUBLE), 6) AS score FROM pairs WHERE lexical > 0)
SELECT source, id, sibling, score FROM scored WHERE score > 0.15 QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY score DESC, sibling) = 1""")
def sibling_section(spark, sf_dir):
    """The best other section of the same parent and depth, by common words and nearness."""
    above = F.array_join(F.slice("heading_path", F.lit(1), F.size("heading_path") - 1), "/")
    rows = _sections(spark, sf_dir).select("source", "id", F.size("heading_path").alias("depth"), above.alias("above"), "words")
    other = rows.select(F.col("source").alias("s"), F.col("id").alias("sibling"), F.col("depth").alias("d"), F.col("above").alias("a"), F.col("words").alias("w"))
    pairs = rows.join(other, (F.col("source") == F.col("s")) & (F.col("depth") == F.col("d")) & (F.col("above") == F.col("a"))).where("id <> sibling")
    lexical = T.jaccard(F.col("words"), F.col("w"))
    scored = pairs.select("source", "id", "sibling", lexical.alias("lexical"), F.round(lexical + F.when(F.abs(F.col("id") - F.col("sibling")) <= 1, 0.2).otherwise(0.0), 6).alias("score"))
    scored = scored.where("lexical > 0 and score > 0.15")
    best = F.row_number().over(Window.partitionBy("source", "id").orderBy(F.desc("score"), "sibling"))
    return scored.withColumn("n", best).where("n = 1").select("source", "id", "sibling", "score")


@query("""WITH chunks AS (SELECT CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS stable_key, l_orderkey || '@' || l_linenumber AS version FROM lineitem),
links AS (SELECT o_custkey AS card, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE o_orderkey || '@' || (o_orderkey % 5 + 1) END AS pin FROM orders),
anchors AS (SELECT l_orderkey || '@' || (l_linenumber + l_orderkey % 2) AS version FROM lineitem), versions AS (SELECT DISTINCT version FROM chunks),
failures AS (
  SELECT 'orphan_link' AS kind, card || '>' || key AS what FROM links WHERE key NOT IN (SELECT stable_key FROM chunks)
  UNION ALL SELECT 'empty_stable_key', version FROM chunks WHERE stable_key = ''
  UNION ALL SELECT 'missing_version_pin', card || '>' || key FROM links WHERE trim(pin) = ''
  UNION ALL SELECT 'unknown_version_pin', card || '>' || key FROM links WHERE trim(pin) <> '' AND pin NOT IN (SELECT version FROM versions)
  UNION ALL SELECT 'orphan_anchor', version FROM anchors WHERE version NOT IN (SELECT version FROM versions)
) SELECT kind, count(*) AS n, min(what) AS first_one FROM failures GROUP BY 1""")
def integrity_checks(spark, sf_dir):
    """Failures by kind: links to unknown keys, empty keys, missing and unknown pins, anchors of unknown versions."""
    k, c = F.col("l_orderkey"), F.col
    at = lambda a, b: F.concat(a.cast("string"), F.lit("@"), b.cast("string"))
    lines = _table(spark, sf_dir, "lineitem").select(
        F.when(k % 19 == 0, "").otherwise(k.cast("string")).alias("stable_key"), at(k, c("l_linenumber")).alias("version"), at(k, c("l_linenumber") + k % 2).alias("anchored"),
    )
    o = c("o_orderkey")
    links = _table(spark, sf_dir, "orders").select(o.cast("string").alias("key"), F.concat(c("o_custkey").cast("string"), F.lit(">"), o.cast("string")).alias("what"), F.when(o % 23 == 0, " ").otherwise(at(o, o % 5 + 1)).alias("pin"))
    kind = lambda df, name, what: df.select(F.lit(name).alias("kind"), F.col(what).alias("what"))
    pinned = links.where("trim(pin) <> ''")
    failures = (
        kind(changes.orphans(links, lines, "key", "stable_key"), "orphan_link", "what")
        .union(kind(lines.where("stable_key = ''"), "empty_stable_key", "version"))
        .union(kind(links.where("trim(pin) = ''"), "missing_version_pin", "what"))
        .union(kind(changes.orphans(pinned, lines, "pin", "version"), "unknown_version_pin", "what"))
        .union(kind(changes.orphans(lines.select("anchored"), lines.select("version"), "anchored", "version"), "orphan_anchor", "anchored"))
    )
    return failures.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("what").alias("first_one"))


# The last index of the documents: some moved, some with another size, time or text.
_INDEXED = """now AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'old/' ELSE source || '/' END || doc_id AS path, n_chars AS size, doc_id % 4 AS mtime, sha256(coalesce(text, '')) AS hash FROM documents),
was AS (SELECT source || '/' || doc_id AS path, n_chars - (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS size, 0 AS mtime, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' edited' ELSE '' END) AS hash FROM documents)"""


@query(f"""WITH {_INDEXED} SELECT coalesce(n.path, w.path) AS path, CASE WHEN n.path IS NULL THEN 'tombstone' WHEN w.path IS NULL THEN 'import' WHEN n.size = w.size AND n.mtime = w.mtime THEN 'skip' WHEN n.hash = w.hash THEN 'touch' ELSE 'reindex' END AS action
FROM now n FULL JOIN was w ON n.path = w.path""")
def reindex_plan(spark, sf_dir):
    """What re-indexing does with each file: equal size and time skip it unread, an equal hash only touches it, a missing file is tombstoned."""
    d, c = F.col("doc_id"), F.col
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    now = docs.select(F.concat(F.when(d % 7 == 0, "old/").otherwise(F.concat("source", F.lit("/"))), d.cast("string")).alias("p"), c("n_chars").alias("size"), (d % 4).alias("mtime"), F.sha2(text, 256).alias("hash"))
    was = docs.select(F.concat("source", F.lit("/"), d.cast("string")).alias("q"), (c("n_chars") - F.when(d % 5 == 0, 1).otherwise(0)).alias("s"), F.lit(0).alias("m"), F.sha2(F.concat(text, F.when(d % 3 == 0, " edited").otherwise("")), 256).alias("h"))
    action = F.when(c("p").isNull(), "tombstone").when(c("q").isNull(), "import").when((c("size") == c("s")) & (c("mtime") == c("m")), "skip").when(c("hash") == c("h"), "touch").otherwise("reindex")
    return now.join(was, c("p") == c("q"), "full").select(F.coalesce("p", "q").alias("path"), action.alias("action"))


@query(f"""WITH {_CARDS}, inbox AS (SELECT id, CASE WHEN type = 'constraint' THEN 'candidate' ELSE 'clarification' END AS type, CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'answered' WHEN 2 THEN 'accepted' ELSE 'rejected' END AS status FROM cards)
SELECT id, type, status, row_number() OVER (ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'answered' THEN 1 WHEN 'accepted' THEN 2 ELSE 3 END, CASE type WHEN 'candidate' THEN 0 ELSE 1 END, id) AS place FROM inbox QUALIFY place <= 20""")
def inbox_listing(spark, sf_dir):
    """The first twenty items: open ones first, candidates before clarifications."""
    i = F.col("id")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "answered").when(i % 4 == 2, "accepted").otherwise("rejected")
    rows = cards(spark, sf_dir).select("id", F.when(F.col("type") == "constraint", "candidate").otherwise("clarification").alias("type"), status.alias("status"))
    state = F.when(F.col("status") == "pending", 0).when(F.col("status") == "answered", 1).when(F.col("status") == "accepted", 2).otherwise(3)
    keys = [state, F.when(F.col("type") == "candidate", 0).otherwise(1), F.col("id")]
    top = rows.orderBy(*keys).limit(20)
    return top.select("id", "type", "status", F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("place"))
