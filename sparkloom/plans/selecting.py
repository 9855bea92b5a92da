"""Queries about the selection of sources and votes on close calls, over the re-ranked sources of all tasks. Importing this module adds them to QUERIES and ORACLES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scoring import rounded
from ..operators import rerank, select
from ..operators import selection as S
from ..sources.scratch import written
from .queries import _ALL_RANKED, query, sql_tokens
from .reranking import _MODEL, _PROFILES, _names, candidates
from .selection import _DEPTH, _DIR, _IN, _OVER, _UNDER

_VERDICT = "CASE WHEN combined = 0 AND best < 0.35 THEN 'unsupported' WHEN combined < 0.05 THEN 'partial' ELSE 'covers' END"
_EQUAL = lambda t: "CASE " + " ".join(f"WHEN {t} IN ({_names(k)}) THEN {list(k)}" for k in select.TITLE_CLASSES) + f" ELSE [{t}] END"
_TELLING = lambda col: f"list_filter({col}, lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_names(select.GENERIC)}))"
_DIRECT = "list_contains(tokens, t)"
_BY_CLASS = f"len(list_intersect(list_filter({_EQUAL('t')}, lambda e: e <> t), tokens)) > 0"


def _subset(col: str) -> str:
    own = f"list_distinct({_TELLING(col)})"
    some = lambda cond: f"len(list_filter({own}, lambda t: {cond})) > 0"
    semantic = some(f"NOT {_DIRECT} AND {_BY_CLASS}")
    ok = f"len({own}) > 0 AND NOT {some(f'NOT ({_DIRECT} OR {_BY_CLASS})')} AND {some('length(t) >= 5')} AND (len({own}) > 1 OR {semantic})"
    return f"CASE WHEN {ok} THEN len({own}) + CASE WHEN {semantic} THEN 0.5 ELSE 0.0 END ELSE 0.0 END"


_SAYS = lambda p: f"len(list_filter(tokens, lambda t: regexp_matches(t, '{p}'))) > 0"
_HISTORY = f"({_SAYS(select.HISTORY)} OR ({_SAYS(select.MOVING)} AND {_SAYS('^v?[0-9]+([.][0-9]+)*$')}))"
_COVERED = f"list_distinct(list_filter(tokens, lambda q: len(list_intersect({_EQUAL('q')}, flatten(list_transform({_TELLING('title_t || file_t')}, lambda t: {_EQUAL('t')})))) > 0))"
_RULES = (
    ("parent_over_leaf", f"broad AND parent AND (kind IN ({_names(select.OVERVIEW_KINDS)}) OR regexp_matches(low, '{select.OVERVIEW_TITLE}') OR stem IN ('readme', 'index', '_index', 'overview'))", select.PARENT),
    ("decision_over_procedural", "intent = 'decision_lookup' AND list_contains(reasons, 'decision_vs_procedural') AND kind IN ('concept', 'adr', 'prd')", select.DECISION),
    ("anchored_over_broad", "intent = 'file_anchored' AND list_contains(reasons, 'guide_vs_reference') AND kind <> 'api_reference'", select.ANCHORED),
    ("changelog_release_intent_preserved", "history", select.CHANGELOG),
    ("title_exact_match_promoted", "exact AND n_exact = 1 AND (n_history = 0 OR history)", select.EXACT),
    ("title_subset_match_promoted", "n_exact <> 1 AND n_history = 0 AND owner", select.SUBSET),
    ("overview_landing_promoted", "n_exact <> 1 AND n_history = 0 AND NOT owned AND asks AND pure AND landing_page AND intent = 'broad_domain'", select.LANDING),
    ("example_for_broad_domain_promoted", "intent = 'broad_domain' AND kind = 'example' AND label IN ('partial', 'covers') AND supported", select.EXAMPLE),
    ("concept_over_leaves_by_purpose_promoted", "broad AND list_contains(reasons, 'concept_over_leaves_by_purpose') AND kind = 'concept' AND (combined >= most - 1e-9 OR asks)", select.CONCEPT),
)
_SAID = "CASE WHEN label = 'covers' THEN 'covers_label' END, " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _RULES) + ", " + ", ".join(f"CASE WHEN label = '{x}' THEN 'demoted_{x}' END" for x in ("too_narrow", "too_broad", "adjacent"))
_BASE = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in select.LABELS.items()) + " END"
_SELECTED = rf"""src0 AS (SELECT item_id AS q, src AS path, rerank_rank AS rank, purpose, coalesce(purpose, '') AS kind, greatest(in_title, in_path, in_heading, own_intro) AS combined, chunk_score AS best, intent, title, tokens, stem, in_title, own_title, own_heading FROM r_final),
src AS (SELECT *, 1 AS fused, false AS starting, {_VERDICT} AS verdict FROM src0),
facts AS (
  SELECT t.q, t.path, coalesce(bool_or({_UNDER}), false) AS parent, coalesce(bool_or({_OVER}), false) AS child, count(o.q) > 0 AND coalesce(bool_and({_DEPTH.format('o.path')} > {_DEPTH.format('t.path')}), true) AS container,
    coalesce(bool_or(o.purpose IN {_IN(S.DECISIONS)}), false) AS has_d, coalesce(bool_or(o.purpose IN {_IN(S.PROCEDURES)}), false) AS has_p, coalesce(bool_or(o.purpose = 'guide'), false) AS has_g, coalesce(bool_or(o.purpose = 'api_reference'), false) AS has_a,
    count(*) FILTER (o.purpose IN {_IN(S.LEAVES)}) AS leaves, coalesce(bool_or({_DIR.format('o.path')} = {_DIR.format('t.path')} AND o.rank < t.rank AND t.combined < 0.35 AND o.combined >= t.combined), false) AS sibling
  FROM src t LEFT JOIN src o ON o.q = t.q AND o.path <> t.path GROUP BY 1, 2
), about AS (
  SELECT src.*, parent, CASE WHEN verdict = 'unsupported' OR (combined < 0.05 AND fused <= 1 AND best < 0.2) THEN 'unsupported' WHEN child AND intent IN ('decision_lookup', 'broad_domain') THEN 'too_narrow'
    WHEN parent AND intent IN ('exact_symbol', 'file_anchored') THEN 'too_broad' WHEN sibling THEN 'adjacent' WHEN verdict = 'partial' THEN 'partial' WHEN combined >= 0.5 AND fused >= 1 AND best >= 0.3 THEN 'covers' ELSE 'partial' END AS label,
  list_filter([CASE WHEN purpose IN ('changelog', 'release_note') OR ends_with(lower(path), 'changelog.md') THEN 'changelog_release_intent' END, CASE WHEN parent THEN 'parent_vs_leaf' END,
    CASE WHEN (purpose IN {_IN(S.DECISIONS)} AND has_p) OR (purpose IN {_IN(S.PROCEDURES)} AND has_d) THEN 'decision_vs_procedural' END,
    CASE WHEN (purpose = 'guide' AND has_a) OR (purpose = 'api_reference' AND has_g) THEN 'guide_vs_reference' END, CASE WHEN purpose = 'concept' AND leaves >= 2 THEN 'concept_over_leaves_by_purpose' END], lambda x: x IS NOT NULL) AS reasons
  FROM src JOIN facts USING (q, path)
), named AS (SELECT *, {sql_tokens('title')} AS title_t, {sql_tokens("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')")} AS file_t, lower(title) AS low, intent IN ('broad_domain', 'decision_lookup') AS broad FROM about),
flagged AS (
  SELECT *, label <> 'unsupported' AND list_contains(reasons, 'changelog_release_intent') AND (purpose IN ('changelog', 'release_note') OR ends_with(lower(path), 'changelog.md') OR ends_with(lower(path), '/release.md')) AND {_HISTORY} AS history,
    len(tokens) > 0 AND (list_sort(list_distinct(title_t)) = list_sort(list_distinct(tokens)) OR list_sort(list_distinct(file_t)) = list_sort(list_distinct(tokens))) AS exact,
    greatest({_subset('title_t')}, {_subset('file_t')}) AS subset, {_COVERED} AS covered, {_SAYS(select.OVERVIEW)} AS asks,
    len(list_filter(list_distinct(tokens), lambda t: t NOT IN ({_names(select.OVERVIEW_NOISE)}))) <= 2 AS pure,
    regexp_matches(low, '{select.LANDING_TITLE}') OR stem IN ('introduction', 'intro', 'overview') OR contains(lower(path), '/introduction/') AS landing_page FROM named
), of_query AS (
  SELECT *, sum(history::INTEGER) OVER w AS n_history, sum(exact::INTEGER) OVER w AS n_exact, max(combined) OVER w AS most, max(subset) OVER w AS top, bool_or(label <> 'unsupported' AND kind = 'concept') OVER w AS supported,
    len(list_distinct(flatten(list(covered) OVER w))) AS n_all FROM flagged WINDOW w AS (PARTITION BY q)
), topped AS (SELECT *, sum((subset >= top - 1e-9)::INTEGER) OVER (PARTITION BY q) AS tops FROM of_query),
owned AS (SELECT *, bool_or(owner) OVER (PARTITION BY q) AS owned FROM (SELECT *, top > 0 AND subset >= top - 1e-9 AND tops = 1 AND len(covered) = n_all AS owner FROM topped)),
promoted AS (SELECT *, list_filter([{_SAID}], lambda x: x IS NOT NULL) AS promotions, {_BASE} + {" + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for _, c, w in _RULES)} - rank * {select.STEP} AS raw FROM owned WHERE label <> 'unsupported'),
capped AS (SELECT *, max(raw) FILTER (kind = 'concept') OVER (PARTITION BY q) AS concept FROM promoted),
placed AS (SELECT *, CASE WHEN list_contains(promotions, 'example_for_broad_domain_promoted') AND raw >= concept THEN concept - {select.STEP} ELSE raw END AS sel FROM capped),
selected AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sel, 9) DESC, rank) AS sel_rank FROM placed)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The re-ranked sources of all tasks with what they are about."""
    c = F.col
    ranked = rerank.reranked(candidates(spark, sf_dir), "item_id").withColumn("combined", F.greatest("in_title", "in_path", "in_heading", "own_intro"))
    verdict = F.when((c("combined") == 0) & (c("chunk_score") < 0.35), "unsupported").when(c("combined") < 0.05, "partial").otherwise("covers")
    ranked = written(ranked.withColumn("verdict", verdict), "reranked")
    sources = ranked.select("item_id", "intent", F.lit(False).alias("starting"), c("rerank_rank").alias("rank"), c("source").alias("path"), "purpose", "combined", F.lit(1).alias("fused"), c("chunk_score").alias("best"), "verdict")
    about = S.aboutness(sources, "item_id").select(c("item_id").alias("q"), c("path").alias("p"), "label", "reasons")
    return ranked.join(about, (c("item_id") == c("q")) & (c("source") == c("p"))).drop("q", "p").withColumnRenamed("rerank_rank", "rank")


@query(f"""WITH RECURSIVE {_ALL_RANKED}, {_PROFILES}, {_MODEL}, {_SELECTED}
SELECT q AS item_id, path AS source, label, array_to_string(promotions, ' ') AS promotions, round(sel, 6) AS selection_score, CAST(sel_rank AS INTEGER) AS selection_rank FROM selected""")
def source_selection(spark, sf_dir):
    out = select.selection(judged(spark, sf_dir), "item_id")
    return out.select("item_id", "source", "label", F.array_join("promotions", " ").alias("promotions"), rounded(F.col("selection_score"), 6).alias("selection_score"), "selection_rank")


_ROLE = "CASE WHEN stem IN ('overview', 'index', 'readme') THEN 'overview' ELSE CASE purpose WHEN 'api_reference' THEN 'api' WHEN 'adr' THEN 'decision' WHEN 'unknown' THEN 'reference' ELSE purpose END END"
_HIT = "CASE WHEN own_title >= 0.5 THEN 'exact' WHEN own_title >= 0.3 THEN 'near' WHEN own_title > 0 THEN 'scattered' ELSE 'none' END"
_CARDS = f"""cards AS (SELECT *, {_ROLE} AS role, CASE WHEN parent THEN 'parent' WHEN label = 'too_narrow' THEN 'child' ELSE 'peer' END AS canon, {_DIR.format('path')} AS family, CASE WHEN stem IN ('index', 'readme') THEN 'parent' ELSE 'child' END AS relation,
  {_HIT} AS hit, CASE WHEN own_title >= own_heading THEN 'title' ELSE 'body' END AS field FROM selected),
pairs AS (SELECT a.q, a.path AS a_source, b.path AS b_source, a.intent, a.tokens, a.sel - b.sel AS gap, a.role AS ar, b.role AS br, a.canon AS ac, b.canon AS bc, a.family = b.family AS kin, a.relation AS al, b.relation AS bl, a.in_title AS at_, b.in_title AS bt,
  regexp_replace(regexp_extract(a.path, '[^/]*$'), '[.][^.]+$', '') AS an, regexp_replace(regexp_extract(b.path, '[^/]*$'), '[.][^.]+$', '') AS bn,
  list_position(['none', 'scattered', 'ordered', 'near', 'exact'], a.hit) + CASE WHEN a.field = 'title' THEN 1 ELSE 0 END - list_position(['none', 'scattered', 'ordered', 'near', 'exact'], b.hit) - CASE WHEN b.field = 'title' THEN 1 ELSE 0 END AS near
  FROM cards a JOIN cards b ON a.q = b.q AND a.sel_rank = 1 AND b.sel_rank = 2 WHERE round(a.sel - b.sel, 9) < {select.CLOSE})"""
_WORD = lambda names: f"len(list_filter(tokens, lambda t: t IN ({_names(names)}))) > 0"
_ONE = lambda x, y, n=1: f"CASE WHEN {x} AND NOT {y} THEN {n} WHEN {y} AND NOT {x} THEN -{n} ELSE 0 END"
_FITS = lambda r: f"CASE WHEN {r} = 'overview' THEN 3 WHEN {r} IN ('guide', 'concept') THEN 2 WHEN {r} IN ('api', 'reference', 'child_detail') THEN 0 ELSE 1 END"
_LEAD = f"CASE WHEN {_FITS('ar')} >= {_FITS('br')} THEN ar ELSE br END"
_IS = lambda name: (f"(ar = '{name}')", f"(br = '{name}')")
_SETTLED, _EXACT = "intent IN ('broad_domain', 'decision_lookup')", "intent IN ('exact_symbol', 'file_anchored')"
_NAMED = lambda n: f"(regexp_matches({n}, '^[A-Za-z][A-Za-z0-9]*$') AND length({n}) >= 2 AND list_contains(tokens, lower({n})))"
_JUDGES = (
    ("'phrase_proximity_stronger'", "CASE WHEN near = 0 THEN 0 ELSE sign(near) * CASE WHEN abs(near) >= 2 THEN 2 ELSE 1 END END"),
    (f"'role_compat_' || {_LEAD} || '_for_broad'", f"CASE WHEN intent = 'broad_domain' AND NOT {_WORD((*select.RELEASE_WORDS, *select.UPGRADE_WORDS))} AND {_LEAD} IN ({_names(select.BROAD_REASONS)}) THEN {_FITS('ar')} - {_FITS('br')} ELSE 0 END"),
    ("'role_compat_api_for_exact'", f"CASE WHEN {_EXACT} THEN {_ONE(*_IS('api'))} ELSE 0 END"),
    ("'role_compat_decision_for_decision_lookup'", f"CASE WHEN intent <> 'decision_lookup' THEN 0 WHEN ar = 'decision' AND br <> 'decision' THEN 2 WHEN br = 'decision' AND ar <> 'decision' THEN -2 WHEN ar = 'concept' AND br NOT IN ('concept', 'decision') THEN 1 WHEN br = 'concept' AND ar NOT IN ('concept', 'decision') THEN -1 ELSE 0 END"),
    ("'role_compat_changelog_for_release_intent'", f"CASE WHEN {_WORD(select.RELEASE_WORDS)} THEN {_ONE(*_IS('changelog'), 2)} ELSE 0 END"),
    ("'role_compat_migration_for_upgrade_intent'", f"CASE WHEN {_WORD(select.UPGRADE_WORDS)} THEN {_ONE(*_IS('migration'), 2)} ELSE 0 END"),
    ("'canonicality_parent_for_broad'", f"CASE WHEN {_SETTLED} THEN {_ONE('(ac = ' + chr(39) + 'parent' + chr(39) + ')', '(bc = ' + chr(39) + 'parent' + chr(39) + ')')} ELSE 0 END"),
    ("'canonicality_leaf_for_exact'", f"CASE WHEN {_EXACT} THEN {_ONE('(ac = ' + chr(39) + 'child' + chr(39) + ')', '(bc = ' + chr(39) + 'child' + chr(39) + ')')} ELSE 0 END"),
    ("'family_parent_over_child'", f"CASE WHEN kin AND {_SETTLED} THEN {_ONE('(al = ' + chr(39) + 'parent' + chr(39) + ')', '(bl = ' + chr(39) + 'parent' + chr(39) + ')')} ELSE 0 END"),
    ("'title_token_coverage_decisive'", f"CASE WHEN abs(at_ - bt) >= 0.3 AND greatest(at_, bt) >= 0.5 AND CASE WHEN at_ > bt THEN {_NAMED('an')} AND NOT {_NAMED('bn')} ELSE {_NAMED('bn')} AND NOT {_NAMED('an')} END THEN sign(at_ - bt) * 3 ELSE 0 END"),
)
_VOTED = f"""voted AS (SELECT *, list_filter([{", ".join(f"{{'d': CAST({d} AS INTEGER), 'r': {r}}}" for r, d in _JUDGES)}], lambda v: v.d <> 0) AS votes FROM pairs),
counted AS (SELECT *, coalesce(list_sum(list_transform(votes, lambda v: v.d)), 0) AS margin FROM voted)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected sources with what the judges of a close call look at."""
    c = F.col
    s = select.selection(judged(spark, sf_dir), "item_id")
    leaf = F.lower(paths.stem(c("source")))
    role = F.when(leaf.isin("overview", "index", "readme"), "overview").when(c("purpose") == "api_reference", "api").when(c("purpose") == "adr", "decision").when(c("purpose") == "unknown", "reference").otherwise(c("purpose"))
    return written(s.select(
        "item_id", "selection_score", "selection_rank", "promotions", "intent", "source", "tokens", role.alias("role"), F.when(F.array_contains("reasons", "parent_vs_leaf"), "parent").when(c("label") == "too_narrow", "child").otherwise("peer").alias("canonicality"),
        F.regexp_replace("source", "/?[^/]*$", "").alias("family"), F.when(leaf.isin("index", "readme"), "parent").otherwise("child").alias("relation"),
        F.when(c("own_title") >= 0.5, "exact").when(c("own_title") >= 0.3, "near").when(c("own_title") > 0, "scattered").otherwise("none").alias("hit"), F.when(c("own_title") >= c("own_heading"), "title").otherwise("body").alias("field"),
        F.array().cast("array<string>").alias("anchors"), c("in_title").alias("title_coverage"),
    ), "cards")


@query(f"""WITH RECURSIVE {_ALL_RANKED}, {_PROFILES}, {_MODEL}, {_SELECTED}, {_CARDS}, {_VOTED}
SELECT q AS item_id, a_source, b_source, round(gap, 6) AS gap, CASE WHEN margin > 0 THEN 'a' WHEN margin < 0 THEN 'b' ELSE 'tie' END AS winner, CASE WHEN abs(margin) >= 3 THEN 'high' WHEN abs(margin) >= 2 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(margin AS INTEGER) AS margin, array_to_string(list_transform(list_filter(votes, lambda v: margin = 0 OR sign(v.d) = sign(margin)), lambda v: v.r), ' ') AS reasons FROM counted""")
def pair_votes(spark, sf_dir):
    v = F.col("verdict")
    out = select.close_calls(cards(spark, sf_dir), "item_id")
    return out.select("item_id", F.col("a.source").alias("a_source"), F.col("b.source").alias("b_source"), rounded(F.col("margin"), 6).alias("gap"), v["winner"].alias("winner"), v["confidence"].alias("confidence"), v["margin"].alias("margin"), F.array_join(v["reasons"], " ").alias("reasons"))
