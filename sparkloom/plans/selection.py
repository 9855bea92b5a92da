"""Queries about phrases, aboutness, families, display order and modes. Importing this module adds them to QUERIES and ORACLES.

Turns of conversations stand in for the sources of a query, with paths by turn and coverages by length of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions import text as T
from ..operators import selection as S
from .queries import _table, query, sql_tokens

PATHS = ("docs/guide.md", "docs/guide/part1.md", "docs/guide/part2.md", "docs/ref/client.md", "docs/ref/v2/api/errors.md", "notes/client.md", "changelog.md", "docs/ref/v2/cli/README.md")
PURPOSES = ("concept", "guide", "api_reference", "guide", "api_reference", "adr", "changelog", "quick_start")
INTENTS = ("decision_lookup", "broad_domain", "exact_symbol", "file_anchored")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], at: str) -> str:
    return f"({list(values)})[{at} + 1]"


_SOURCES = f"""raw AS (SELECT conv_id AS q, turn, length(coalesce(text, '')) AS n FROM conversations),
src AS (SELECT q, turn, n, {_sql_pick(INTENTS, 'q % 4')} AS intent, q % 3 = 0 AS starting, (turn * 3 + q) % 8 AS rank, {_sql_pick(PATHS, 'turn % 8')} AS path, {_sql_pick(PURPOSES, 'turn % 8')} AS purpose,
  CAST(greatest(n % 7 * 2, n % 5 * 2, n % 11, CASE WHEN n % 3 = 0 THEN 0 ELSE n % 13 END) AS DOUBLE) / 20 AS combined, n % 3 AS fused, CAST(n % 10 AS DOUBLE) / 10 AS best,
  CASE n % 9 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'needs_anchors' WHEN 2 THEN 'partial' ELSE 'covers' END AS verdict,
  CASE turn % 8 WHEN 1 THEN ['symbol:client'] WHEN 6 THEN ['route:/v1', 'symbol:client'] ELSE [] END AS aliases FROM raw)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, t = F.col, F.col("n"), F.col("turn")
    raw = _table(spark, sf_dir, "conversations").select(c("conv_id").alias("q"), "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    # The coverage of a source is the best of title, path, headings and introduction; some have no introduction.
    combined = F.greatest(n % 7 * 2, n % 5 * 2, n % 11, F.when(n % 3 == 0, 0).otherwise(n % 13)).cast("double") / 20
    verdict = F.when(n % 9 == 0, "unsupported").when(n % 9 == 1, "needs_anchors").when(n % 9 == 2, "partial").otherwise("covers")
    aliases = F.when(t % 8 == 1, F.array(F.lit("symbol:client"))).when(t % 8 == 6, F.array(F.lit("route:/v1"), F.lit("symbol:client"))).otherwise(F.array().cast("array<string>"))
    return raw.select(
        "q", "turn", "n", _pick(INTENTS, c("q") % 4).alias("intent"), (c("q") % 3 == 0).alias("starting"), ((t * 3 + c("q")) % 8).alias("rank"), _pick(PATHS, t % 8).alias("path"),
        _pick(PURPOSES, t % 8).alias("purpose"), combined.alias("combined"), (n % 3).alias("fused"), (n % 10).cast("double").alias("tenths"), ((n % 10).cast("double") / 10).alias("best"),
        verdict.alias("verdict"), aliases.alias("aliases"),
    ).drop("tenths")


_UNDER = r"o.path <> t.path AND starts_with(o.path, regexp_replace(t.path, '\.[^./]*$', '') || '/')"
_OVER = r"o.path <> t.path AND starts_with(t.path, regexp_replace(o.path, '\.[^./]*$', '') || '/')"
_DIR = "regexp_replace({}, '/?[^/]*$', '')"
_DEPTH = "len(list_filter(string_split({}, '/'), lambda s: s <> ''))"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(rf"""WITH {_SOURCES}, facts AS (
  SELECT t.q, t.turn, coalesce(bool_or({_UNDER}), false) AS parent, coalesce(bool_or({_OVER}), false) AS child, count(o.q) > 0 AND coalesce(bool_and({_DEPTH.format('o.path')} > {_DEPTH.format('t.path')}), true) AS container,
    coalesce(bool_or(o.purpose IN {_IN(S.DECISIONS)}), false) AS has_d, coalesce(bool_or(o.purpose IN {_IN(S.PROCEDURES)}), false) AS has_p, coalesce(bool_or(o.purpose = 'guide'), false) AS has_g, coalesce(bool_or(o.purpose = 'api_reference'), false) AS has_a,
    count(*) FILTER (o.purpose IN {_IN(S.LEAVES)}) AS leaves, coalesce(bool_or({_DIR.format('o.path')} = {_DIR.format('t.path')} AND o.rank < t.rank AND t.combined < 0.35 AND o.combined >= t.combined), false) AS sibling
  FROM src t LEFT JOIN src o ON o.q = t.q AND o.path <> t.path GROUP BY 1, 2)
SELECT q, path, CAST(rank AS BIGINT) AS rank, combined,
  CASE WHEN verdict IN ('unsupported', 'needs_anchors') OR (combined < 0.05 AND fused <= 1 AND best < 0.2) THEN 'unsupported' WHEN child AND intent IN ('decision_lookup', 'broad_domain') THEN 'too_narrow'
    WHEN parent AND intent IN ('exact_symbol', 'file_anchored') THEN 'too_broad' WHEN sibling THEN 'adjacent' WHEN verdict = 'partial' THEN 'partial'
    WHEN intent = 'broad_domain' AND purpose = 'quick_start' AND starting AND combined >= 0.2 AND fused >= 1 AND best >= 0.25 THEN 'covers' WHEN combined >= 0.5 AND fused >= 1 AND best >= 0.3 THEN 'covers' ELSE 'partial' END AS label,
  array_to_string(list_filter([CASE WHEN purpose IN ('changelog', 'release_note') OR ends_with(lower(path), 'changelog.md') THEN 'changelog_release_intent' END, CASE WHEN parent THEN 'parent_vs_leaf' END, CASE WHEN parent AND purpose IN {_IN(S.OVERVIEWS)} THEN 'overview_vs_leaf' END,
    CASE WHEN container AND NOT parent THEN 'broad_container_vs_specific_topic' END, CASE WHEN (purpose IN {_IN(S.DECISIONS)} AND has_p) OR (purpose IN {_IN(S.PROCEDURES)} AND has_d) THEN 'decision_vs_procedural' END,
    CASE WHEN (purpose = 'guide' AND has_a) OR (purpose = 'api_reference' AND has_g) THEN 'guide_vs_reference' END, CASE WHEN purpose = 'concept' AND leaves >= 2 THEN 'concept_over_leaves_by_purpose' END], lambda x: x IS NOT NULL), ' ') AS reasons
FROM src JOIN facts USING (q, turn)""")
def source_aboutness(spark, sf_dir):
    return S.aboutness(sources(spark, sf_dir), "q").withColumn("reasons", F.array_join("reasons", " "))


_STEM = r"regexp_replace(regexp_extract(low, '[^/]*$'), '\.[^./]*$', '')"
_INSIDE = "({o}.dir = {s}.root OR starts_with({o}.dir, {s}.root || '/'))"
_BASE, _ALIAS = "(length(a.stem) >= 4 AND a.stem = b.stem)", "list_filter(b.aliases, lambda x: list_contains(a.aliases, x))[1]"
_FAMILIES = rf"""{_SOURCES}, k AS (SELECT *, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || stem AS root, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS parts FROM (
  SELECT q, path, rank, best, aliases, lower(path) AS low, {_DIR.format('lower(path)')} AS dir, {_STEM.replace('low', 'lower(path)')} AS stem, row_number() OVER (PARTITION BY q ORDER BY rank, path) - 1 AS idx FROM src)),
pairs AS (SELECT a.q, a.idx AS x, b.idx AS y, list_filter([CASE WHEN {_INSIDE.format(o='b', s='a')} THEN 'sibling_index_parent_of_dir' END, CASE WHEN {_INSIDE.format(o='a', s='b')} THEN 'sibling_index_parent_of_dir' END,
    CASE WHEN a.parts >= 2 AND a.dir = b.dir THEN 'same_parent_dir' END,
    CASE WHEN a.parts >= 2 AND b.parts >= 2 AND {_DIR.format('a.dir')} = {_DIR.format('b.dir')} AND a.dir <> b.dir AND (a.parts >= 3 OR {_BASE} OR {_ALIAS} IS NOT NULL) THEN 'same_grandparent_dir' END,
    CASE WHEN {_BASE} THEN 'shared_basename:' || a.stem END, 'shared_alias:' || {_ALIAS}], lambda x: x IS NOT NULL) AS e FROM k a JOIN k b ON a.q = b.q AND a.idx < b.idx),
edges AS (SELECT q, x, y, e FROM pairs WHERE len(e) > 0 UNION ALL SELECT q, y, x, e FROM pairs WHERE len(e) > 0),
reach AS (SELECT q, idx, idx AS label FROM k UNION SELECT r.q, e.y, r.label FROM reach r JOIN edges e ON e.q = r.q AND e.x = r.idx),
labels AS (SELECT q, idx, min(label) AS label FROM reach GROUP BY 1, 2),
fam AS (SELECT k.q, path, rank, best, idx, 'family_' || (dense_rank() OVER (PARTITION BY k.q ORDER BY label) - 1) AS family,
  first_value(path) OVER (PARTITION BY k.q, label ORDER BY CASE WHEN stem IN ('index', 'readme') THEN 0 WHEN dir <> '' AND stem = regexp_extract(dir, '[^/]*$') THEN 1 ELSE 2 END, parts, idx) AS family_root FROM k JOIN labels USING (q, idx))"""


@query(f"""WITH RECURSIVE {_FAMILIES}, found AS (SELECT q, x AS idx, flatten(list(e ORDER BY y)) AS e FROM edges GROUP BY 1, 2)
SELECT fam.q, path, CAST(rank AS BIGINT) AS rank, family, family_root, coalesce(array_to_string(list_filter(e, lambda v, i: list_position(e, v) = i), ' '), '') AS evidence FROM fam LEFT JOIN found USING (q, idx)""")
def source_families(spark, sf_dir):
    return S.families(sources(spark, sf_dir), "q").withColumn("evidence", F.array_join("evidence", " "))


@query(f"""WITH RECURSIVE {_FAMILIES}, s AS (SELECT q, list({{'f': family, 'p': path, 'b': best}} ORDER BY rank, path) AS s FROM fam GROUP BY 1),
c AS (SELECT *, coalesce(len(s) > 1 AND s[1].f = s[2].f AND round(s[1].b - s[2].b, 9) <= {S.CLOSE_CALL}, false) AS ambiguous FROM s)
SELECT q, ambiguous, CASE WHEN ambiguous THEN array_to_string(list_transform(list_filter(s, lambda m: m.f = s[1].f), lambda m: m.p), ' ') ELSE s[1].p END AS paths FROM c""")
def family_ambiguity(spark, sf_dir):
    cards = sources(spark, sf_dir)
    members = S.families(cards, "q").join(cards.select(F.col("q").alias("q2"), F.col("path").alias("p2"), "best"), (F.col("q") == F.col("q2")) & (F.col("path") == F.col("p2")))
    return S.top_family(members.select("q", "rank", "path", "family", "best"), "q", "best").withColumn("paths", F.array_join("paths", " "))


@query(f"""WITH {_SOURCES}, g AS (SELECT q, turn, rank, {_DIR.format('path')} AS grp, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q, {_DIR.format('path')} ORDER BY rank) AS nth FROM src)
SELECT q, turn, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN n > 2 AND nth > 1 THEN 1 ELSE 0 END, rank) AS place FROM g""")
def diversified_tail(spark, sf_dir):
    rows = sources(spark, sf_dir).select("q", "turn", "rank", F.regexp_replace("path", "/?[^/]*$", "").alias("grp"))
    return S.diversified(rows, "q", "grp", "rank", keep_first=True).select("q", "turn", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {_SOURCES}, m AS (SELECT q, q % 5 AS provided, q % 3 AS recognised, (['anchored', 'unanchored', 'signal_empty'])[q % 3 + 1] AS initial, max(best) AS strongest, bool_or(verdict = 'covers') AND q % 7 <> 0 AS selected, bool_or(verdict <> 'unsupported') AS supported FROM src GROUP BY 1)
SELECT q, CASE WHEN up THEN 'anchored' ELSE initial END AS mode, CASE WHEN up THEN 'anchors_supported_by_retrieval' ELSE 'preserve_initial_mode' END AS reason
FROM (SELECT *, provided > 0 AND initial <> 'anchored' AND recognised > 0 AND strongest >= 0.5 AND (selected OR supported) AS up FROM m)""")
def query_mode_honesty(spark, sf_dir):
    """A mode becomes anchored where anchors were given and recognised and what was found is strong and of use."""
    q = F.col("q")
    m = sources(spark, sf_dir).groupBy("q").agg(F.max("best").alias("strongest"), F.bool_or(F.col("verdict") == "covers").alias("covered"), F.bool_or(F.col("verdict") != "unsupported").alias("supported"))
    initial = _pick(("anchored", "unanchored", "signal_empty"), q % 3)
    up = (q % 5 > 0) & (initial != "anchored") & (q % 3 > 0) & (F.col("strongest") >= 0.5) & ((F.col("covered") & (q % 7 != 0)) | F.col("supported"))
    return m.select("q", F.when(up, "anchored").otherwise(initial).alias("mode"), F.when(up, "anchors_supported_by_retrieval").otherwise("preserve_initial_mode").alias("reason"))


# The phrase is three words of the text, near or far from each other; the fields are parts of the same text.
_PHRASE_FIELDS = {"title": "array_to_string(w[1:6], ' ')", "heading": "array_to_string(w[3:12], '-')", "intro": "array_to_string(w[1:25], ' ')", "body": "array_to_string(w, ' ')"}
_SQL_PHRASE = lambda c: sql_tokens(rf"regexp_replace({c}, '[-_/\\]+', ' ', 'g')")
_JOINED = lambda f, gap: f"regexp_matches(' ' || array_to_string({f}, ' ') || ' ', ' ' || array_to_string(ask, '(?: [^ ]+){{0,{gap - 1}}} ') || ' ')"
_HIT = lambda f: f"CASE WHEN len(ask) = 0 OR NOT list_has_all({f}, ask) THEN 'none' WHEN len(ask) = 1 THEN 'exact' " + " ".join(f"WHEN {_JOINED(f, g)} THEN '{h}'" for h, g in phrases.GAPS) + " ELSE 'scattered' END"
_RANK = lambda h: f"list_position(['none', 'scattered', 'ordered', 'near', 'exact'], {h}) - 1"


@query(f"""WITH words AS (SELECT conv_id, turn, regexp_split_to_array(trim(coalesce(text, '')), '[\\s]+') AS w FROM conversations),
fields AS (SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in _PHRASE_FIELDS.items())}, array_to_string([w[1 + turn], w[2 + turn + conv_id % 5], w[4 + turn + conv_id % 11]], ' ') AS phrase FROM words),
tok AS (SELECT conv_id, turn, {_SQL_PHRASE('phrase')} AS ask, {', '.join(f'{_SQL_PHRASE(k)} AS {k}' for k in _PHRASE_FIELDS)} FROM fields),
hits AS (SELECT conv_id, turn, {', '.join(f'{_HIT(k)} AS {k}' for k in _PHRASE_FIELDS)} FROM tok), r AS (SELECT *, greatest({', '.join(_RANK(k) for k in _PHRASE_FIELDS)}) AS best FROM hits)
SELECT conv_id, turn, {', '.join(_PHRASE_FIELDS)}, CASE WHEN best = 0 THEN 'none' {' '.join(f"WHEN {_RANK(k)} = best THEN '{k}'" for k in _PHRASE_FIELDS)} END AS best_field FROM r""")
def phrase_proximity(spark, sf_dir):
    w = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    rows = _table(spark, sf_dir, "conversations").withColumn("w", w)
    at = lambda i: F.get("w", i.cast("int"))
    turn, conv = F.col("turn"), F.col("conv_id")
    phrase = F.concat_ws(" ", at(turn), at(turn + 1 + conv % 5), at(turn + 3 + conv % 11))
    parts = {"title": F.array_join(F.slice("w", 1, 6), " "), "heading": F.array_join(F.slice("w", 3, 10), "-"), "intro": F.array_join(F.slice("w", 1, 25), " "), "body": F.array_join("w", " ")}
    tokens = rows.select("conv_id", "turn", phrases.phrase_tokens(phrase).alias("ask"), *[phrases.phrase_tokens(v).alias(k) for k, v in parts.items()])
    hits = tokens.select("conv_id", "turn", *[phrases.phrase_hit(F.col("ask"), F.col(k)).alias(k) for k in parts])
    return hits.withColumn("best_field", phrases.best_field({k: F.col(k) for k in parts}))

