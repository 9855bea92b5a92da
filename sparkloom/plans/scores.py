"""Scores of chunks and rules, locks, and packs with locked rules. Importing this module adds the queries to QUERIES and ORACLES.

Turns of conversations stand in for chunks, their conversation's first turn for the task, the document of the same number for the chunk's
scope. Labelled documents stand in for rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunk_scores as C
from ..functions import paths as P
from ..functions import scoring as S
from ..functions import text as T
from ..operators import budget
from ..sources.scratch import written
from .queries import _table, query, sql_light, sql_tokens

ROLES = [("**/assistant/part[13].md", "example"), ("src1*/**", "archive"), ("**/part5.md", "ideation")]
LAYERS = {"en": "module", "de": "project", "fr": "team", "es": "company"}
QUERY = {"project": "src0", "module": "en", "team": "t3", "company": "acme"}
#: Scores are rounded just above the half, as they are products of short decimals and would fall on it.
MIN_SCORE, PACK_BUDGET = 0.05, 300

_LAYER = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " ELSE 'unknown' END"
_CHUNKS = f"""first_turn AS (SELECT conv_id, min_by(text, turn) AS task FROM conversations GROUP BY 1),
chunks AS (
  SELECT c.conv_id AS q, c.turn AS id, c.text AS body, task, source AS project, lang AS module, 't' || (n_chars % 5) AS team, CASE WHEN lang = 'es' THEN 'acme' END AS company, {_LAYER} AS layer,
    source || '/' || c.role || '/part' || c.turn || '.md' AS path, regexp_extract(c.text, '^\\s*(\\S+\\s+\\S+\\s+\\S+\\s+\\S+)', 1) AS heading, CAST(n_chars % 20 + 1 AS INTEGER) AS n_parts,
    CAST(ceil(length(c.text) / 4) AS INTEGER) AS tokens, CASE c.turn % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'unanchored' ELSE 'signal_empty' END AS mode
  FROM conversations c JOIN first_turn USING (conv_id) JOIN documents d ON d.doc_id = c.conv_id
)"""
_SCORED = rf"""{_CHUNKS}, parts AS (
  SELECT *, {sql_tokens("task")} AS tt, {sql_tokens("body")} AS bt, {sql_light("task")} AS ht, {sql_light("heading")} AS hh, least(CAST(id AS INTEGER) + 1, n_parts) AS part,
    list_distinct({sql_tokens("heading")}) AS hs, list_distinct({sql_tokens("replace(regexp_replace(path, '.md$', ''), '/', ' ')")}) AS ps,
    CASE WHEN regexp_matches(path, '^(?:.*/)?assistant/part\[13\]\.md$') THEN 'example' WHEN regexp_matches(path, '^src1[^/]*/.*$') THEN 'archive' WHEN regexp_matches(path, '^(?:.*/)?part5\.md$') THEN 'ideation' ELSE 'canonical' END AS role
  FROM chunks
), terms AS (
  SELECT *, CASE WHEN len(tt) > 0 THEN len(list_filter(tt, lambda x: list_contains(bt, x))) / len(tt) ELSE 0 END AS bm25,
    CASE WHEN len(list_distinct(list_concat(ht, hh))) > 0 THEN len(list_intersect(ht, hh)) / len(list_distinct(list_concat(ht, hh))) ELSE 0 END AS heading_match,
    CASE WHEN module = 'en' AND project = 'src0' THEN 1.0 WHEN project = 'src0' THEN 0.6 WHEN team = 't3' OR company = 'acme' THEN 0.3 ELSE 0 END AS scope_match,
    CASE WHEN path LIKE '%/user/part2.md' THEN 0.5 ELSE 0 END AS mention_overlap,
    len(list_intersect(list_distinct(tt), hs)) AS in_heading, len(list_intersect(list_distinct(tt), ps)) AS in_path
  FROM parts
), factors AS (
  SELECT *, CAST(CASE layer WHEN 'module' THEN 1.1 WHEN 'project' THEN 1.0 WHEN 'company' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS specificity,
    CAST(CASE WHEN mode <> 'anchored' OR scope_match > 0 THEN 1.0 WHEN mention_overlap > 0 THEN 0.15 ELSE 0.10 END AS DOUBLE) AS structure,
    CAST(CASE WHEN role = 'archive' THEN 0.3 WHEN mode <> 'unanchored' AND role = 'ideation' THEN 0.5 WHEN mode <> 'unanchored' AND role = 'example' THEN 0.4 ELSE 1 END AS DOUBLE) AS role_factor,
    CASE WHEN n_parts <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE) * (part - 1) / (n_parts - 1) END AS decay,
    (CAST(0.7 AS DOUBLE) * bm25 + CAST(0.3 AS DOUBLE) * heading_match) * (1 + CAST(0.7 AS DOUBLE) * CAST(scope_match AS DOUBLE)) * (1 + CAST(0.8 AS DOUBLE) * CAST(mention_overlap AS DOUBLE)) AS text_score
  FROM terms
), scored AS (
  SELECT *, text_score * (specificity * role_factor * structure * decay * CAST(CASE WHEN in_heading >= 3 THEN 1.2 ELSE 1 END AS DOUBLE)
      * CAST(CASE WHEN in_path >= 3 THEN 1.7 WHEN in_path = 2 THEN 1.4 WHEN in_path = 1 THEN 1.1 ELSE 1 END AS DOUBLE)) * CAST(CASE WHEN n_parts > 15 THEN 0.85 ELSE 1 END AS DOUBLE) AS final,
    text_score * (specificity * structure * CAST(1.2 AS DOUBLE)) AS card_final
  FROM factors
)"""
_RANKED = f"""{_SCORED}, ranked AS (
  SELECT *, round(final + 1e-9, 6) AS final_score, round(final / sqrt(CASE WHEN tokens > 0 THEN tokens ELSE 1 END), 6) AS packing_score FROM scored
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    task = turns.groupBy(F.col("conv_id").alias("c")).agg(F.min_by("text", "turn").alias("task"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source", "lang", "n_chars")
    both = turns.join(task, F.col("conv_id") == F.col("c")).join(docs, F.col("conv_id") == F.col("d"))
    layer = F.lit("unknown")
    for lang, name in LAYERS.items():
        layer = F.when(F.col("lang") == lang, name).otherwise(layer)
    mode = F.when(F.col("turn") % 3 == 0, "anchored").when(F.col("turn") % 3 == 1, "unanchored").otherwise("signal_empty")
    return both.select(
        F.col("conv_id").alias("q"), F.col("turn").alias("id"), F.col("text").alias("body"), "task", F.col("source").alias("project"), F.col("lang").alias("module"),
        F.concat(F.lit("t"), (F.col("n_chars") % 5).cast("string")).alias("team"), F.when(F.col("lang") == "es", "acme").alias("company"), layer.alias("layer"),
        F.concat("source", F.lit("/"), "role", F.lit("/part"), F.col("turn").cast("string"), F.lit(".md")).alias("path"),
        F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+\s+\S+)", 1).alias("heading"), (F.col("n_chars") % 20 + 1).cast("int").alias("n_parts"),
        T.token_estimate(F.col("text")).alias("tokens"), mode.alias("mode"),
    )


def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks plus bm25 (a token coverage stands in for it), heading_match, scope_match, mention_overlap, and the scores of a chunk and of a rule."""
    c = F.col
    parts = chunks(spark, sf_dir).select(
        "*", T.tokenize(c("task")).alias("tt"), T.tokenize(c("body")).alias("bt"), F.array_distinct(T.tokenize(c("heading"))).alias("hs"),
        F.array_distinct(T.tokenize(C.path_words(c("path")))).alias("ps"), P.first_match(c("path"), ROLES, F.lit("canonical")).alias("role"),
        F.least(c("id").cast("int") + 1, c("n_parts")).alias("part"),
    )
    asked = {"file": F.array(F.lit("docs/user/part2.md")), "symbol": F.array(F.lit("Scheduler"))}
    scopes = [{"project": F.lit(QUERY["project"]), "module": F.lit(QUERY["module"])}, {"team": F.lit(QUERY["team"])}, {"company": F.lit(QUERY["company"])}]
    terms = parts.select(
        "*", T.coverage(c("tt"), c("bt")).alias("bm25"), T.jaccard(T.light_tokens(c("task")), T.light_tokens(c("heading"))).alias("heading_match"),
        C.best_scope(scopes, {k: c(k) for k in ("project", "module", "team", "company")}).alias("scope_match"),
        C.mention_overlap(asked, {"file": F.array("path")}).alias("mention_overlap"),
        F.size(F.array_intersect(F.array_distinct("tt"), c("hs"))).alias("in_heading"), F.size(F.array_intersect(F.array_distinct("tt"), c("ps"))).alias("in_path"),
    )
    four = [c(x) for x in ("bm25", "heading_match", "scope_match", "mention_overlap")]
    return terms.select(
        "*", C.specificity(c("layer")).alias("specificity"), C.structure_factor(c("mode"), c("scope_match"), c("mention_overlap")).alias("structure"),
        C.chunk_score(*four, c("layer"), c("role"), c("mode"), c("part"), c("n_parts"), c("in_heading"), c("in_path")).alias("final"),
        C.card_score(*four, c("layer"), c("mode")).alias("card_final"),
    )


def ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored_chunks(spark, sf_dir)
    return out.select("*", F.round(F.col("final") + 1e-9, 6).alias("final_score"), F.round(S.packing_score(F.col("final"), F.col("tokens")), 6).alias("packing_score"))


@query(f"""WITH {_RANKED} SELECT q, id, role, mode, layer, round(bm25, 6) AS bm25, round(heading_match, 6) AS heading_match, CAST(scope_match AS DOUBLE) AS scope_match, CAST(mention_overlap AS DOUBLE) AS mention_overlap,
  CAST(structure AS DOUBLE) AS structure, final_score, packing_score, row_number() OVER (PARTITION BY q ORDER BY final_score DESC, packing_score DESC, id) AS trace_rank FROM ranked""")
def score_chunk(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("final_score"), F.desc("packing_score"), "id"))
    return ranked_chunks(spark, sf_dir).select(
        "q", "id", "role", "mode", "layer", F.round("bm25", 6).alias("bm25"), F.round("heading_match", 6).alias("heading_match"), "scope_match", "mention_overlap", "structure",
        "final_score", "packing_score", rank.cast("bigint").alias("trace_rank"),
    )


@query(f"WITH {_RANKED} SELECT q, id, round(card_final + 1e-9, 6) AS final_score, greatest(1, CAST(ceil((length(body) + length(heading)) / 4) AS INTEGER)) AS tokens, round(card_final / sqrt(greatest(1, ceil((length(body) + length(heading)) / 4))), 6) AS packing_score FROM ranked")
def score_card(spark, sf_dir):
    tokens = F.greatest(F.lit(1), F.ceil((F.length("body") + F.length("heading")) / 4).cast("int"))
    out = scored_chunks(spark, sf_dir).select("q", "id", F.round(F.col("card_final") + 1e-9, 6).alias("final_score"), tokens.alias("tokens"), "card_final")
    return out.select("q", "id", "final_score", "tokens", F.round(S.packing_score(F.col("card_final"), F.col("tokens")), 6).alias("packing_score"))


_PACK = f"""{_RANKED}, locks AS (SELECT q, 60 * (q % 7) AS locked FROM (SELECT DISTINCT q FROM ranked)),
judged AS (
  SELECT *, CASE WHEN id % 4 = 1 THEN id % 5 END AS selection_rank, CASE WHEN id % 3 <> 0 THEN id % 4 END AS rerank_rank, greatest(0, locked - {PACK_BUDGET}) AS overhead, greatest(0, {PACK_BUDGET} - locked) AS remaining
  FROM ranked JOIN locks USING (q)
), kept AS (
  SELECT *, final_score >= {MIN_SCORE} OR coalesce(selection_rank <= 3, false) AS clears, NOT bool_or(final_score >= {MIN_SCORE} OR coalesce(selection_rank <= 3, false)) OVER (PARTITION BY q) AS safety_net FROM judged
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY selection_rank NULLS LAST, rerank_rank NULLS LAST, packing_score DESC, final_score DESC, specificity DESC, round(bm25, 6) DESC, round(heading_match, 6) DESC, id) AS place
  FROM kept WHERE clears OR safety_net
), fill AS (
  SELECT q, place, tokens <= remaining AS fits, CASE WHEN tokens <= remaining THEN tokens ELSE 0 END AS used FROM ordered WHERE place = 1
  UNION ALL
  SELECT o.q, o.place, f.used + o.tokens <= o.remaining, f.used + CASE WHEN f.used + o.tokens <= o.remaining THEN o.tokens ELSE 0 END FROM fill f JOIN ordered o ON o.q = f.q AND o.place = f.place + 1
), packed AS (
  SELECT q, id, place, safety_net, overhead, remaining, CASE WHEN fits THEN 'included' ELSE 'budget' END AS fate FROM ordered JOIN fill USING (q, place)
  UNION ALL SELECT q, id, NULL, safety_net, overhead, remaining, 'below_threshold' FROM kept WHERE NOT clears AND NOT safety_net
)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's place and fate in a pack under what the locked rules leave of the budget.

    Candidates below the threshold are left out unless selected among the first three; if none is left, all stay. Ranks that a
    candidate lacks sort last.
    """
    c = F.col
    locked = 60 * (c("q") % 7)
    judged = ranked_chunks(spark, sf_dir).select(
        "*", F.when(c("id") % 4 == 1, c("id") % 5).alias("selection_rank"), F.when(c("id") % 3 != 0, c("id") % 4).alias("rerank_rank"),
        F.greatest(F.lit(0), locked - PACK_BUDGET).alias("overhead"), F.greatest(F.lit(0), PACK_BUDGET - locked).alias("remaining"),
    )
    clears = (c("final_score") >= MIN_SCORE) | F.coalesce(c("selection_rank") <= 3, F.lit(False))
    kept = judged.withColumn("clears", clears).withColumn("safety_net", ~F.bool_or("clears").over(Window.partitionBy("q")))
    order = Window.partitionBy("q").orderBy(
        F.asc_nulls_last("selection_rank"), F.asc_nulls_last("rerank_rank"), F.desc("packing_score"), F.desc("final_score"), F.desc("specificity"),
        F.desc(F.round("bm25", 6)), F.desc(F.round("heading_match", 6)), "id",
    )
    ordered = written(kept.where("clears or safety_net").withColumn("place", F.row_number().over(order)), "ordered")
    filled = budget.greedy_fill(ordered, "q", "place", "tokens", "remaining")
    some = ["q", "id", F.col("place").cast("bigint").alias("place"), "safety_net", "overhead", "remaining"]
    out = filled.select(*some, F.when(c("included"), "included").otherwise("budget").alias("fate"))
    below = kept.where("not clears and not safety_net").withColumn("place", F.lit(None).cast("bigint"))
    return out.unionByName(below.select(*some, F.lit("below_threshold").alias("fate")))


@query(f"WITH RECURSIVE {_PACK} SELECT q, id, coalesce(place, 0) AS place, safety_net, CAST(overhead AS BIGINT) AS overhead, CAST(remaining AS BIGINT) AS remaining, fate FROM packed")
def pack_with_locked(spark, sf_dir):
    out = packed(spark, sf_dir).withColumn("place", F.coalesce("place", F.lit(0).cast("bigint"))).withColumn("overhead", F.col("overhead").cast("bigint"))
    return out.withColumn("remaining", F.col("remaining").cast("bigint"))


@query(f"WITH RECURSIVE {_PACK} SELECT fate AS reason, count(*) AS n, count(DISTINCT q) AS packs FROM packed WHERE fate <> 'included' GROUP BY 1")
def omitted_reasons(spark, sf_dir):
    out = packed(spark, sf_dir).where("fate <> 'included'")
    return out.groupBy(F.col("fate").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("q").alias("packs"))


_CARDS = f"""cards AS (
  SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'constraint' WHEN 1 THEN 'symbol_note' ELSE 'evidence' END AS type, CASE WHEN toxic = 1 THEN 'deprecated' ELSE 'active' END AS authority, {_LAYER} AS layer,
    CASE WHEN n_chars % 4 <> 0 THEN source END AS project, lang AS module, 't' || (n_chars % 5) AS team, CASE WHEN n_chars % 3 = 0 THEN 'acme' WHEN n_chars % 3 = 1 THEN 'other' END AS company,
    ['Sym' || (n_chars % 11), 'Sym' || (n_chars % 13)] AS symbols,
    CASE n_chars % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'maybe_affected' ELSE 'potentially_superseded' END AS freshness,
    [doc_id - 2, doc_id - 5, doc_id - 8] AS covers, quality
  FROM labels JOIN documents USING (doc_id)
)"""
STATES = ("verified", "unverified", "needs_review", "maybe_affected", "potentially_superseded")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").drop("text"), "doc_id")
    layer, state = F.lit("unknown"), F.lit(STATES[-1])
    for lang, name in LAYERS.items():
        layer = F.when(c("lang") == lang, name).otherwise(layer)
    for i, name in enumerate(STATES[:-1]):
        state = F.when(c("n_chars") % 5 == i, name).otherwise(state)
    symbol = lambda n: F.concat(F.lit("Sym"), (c("n_chars") % n).cast("string"))
    return both.select(
        c("doc_id").alias("id"), F.when(c("doc_id") % 3 == 0, "constraint").when(c("doc_id") % 3 == 1, "symbol_note").otherwise("evidence").alias("type"),
        F.when(c("toxic") == 1, "deprecated").otherwise("active").alias("authority"), layer.alias("layer"), F.when(c("n_chars") % 4 != 0, c("source")).alias("project"),
        c("lang").alias("module"), F.concat(F.lit("t"), (c("n_chars") % 5).cast("string")).alias("team"),
        F.when(c("n_chars") % 3 == 0, "acme").when(c("n_chars") % 3 == 1, "other").alias("company"), F.array(symbol(11), symbol(13)).alias("symbols"), state.alias("freshness"),
        F.array(c("doc_id") - 2, c("doc_id") - 5, c("doc_id") - 8).alias("covers"), "quality",
    )


_LOCKED = f"""{_CARDS}, scopes AS (SELECT * FROM (VALUES ('src0', 'en', 't3', 'acme'), ('src1', NULL, 't1', NULL)) AS s(p, m, t, c)),
constraint_locks AS (
  SELECT id, max_by(path, (length(path), path)) AS path, bool_or(layer = 'company') AS broad FROM (
    SELECT id, layer, CASE WHEN layer = 'company' AND NOT coalesce(company <> c, false) THEN 'company:' || coalesce(company, '*') || ' (universal)'
      WHEN layer = 'team' AND team = t THEN 'team:' || team
      WHEN layer = 'project' AND project = p THEN 'project:' || project || ' -> ' || coalesce('module:' || m, 'project:' || p)
      WHEN layer = 'module' AND module = m AND (project IS NULL OR project = p) THEN 'module:' || module END AS path
    FROM cards, scopes WHERE type = 'constraint' AND authority <> 'deprecated') WHERE path IS NOT NULL GROUP BY 1
), locks AS (
  SELECT id, 'constraint_scope' AS kind, path AS detail, broad FROM constraint_locks
  UNION ALL SELECT id, 'symbol_note', list_filter(symbols, lambda x: x IN ('Sym3', 'Sym7'))[1], false FROM cards WHERE type = 'symbol_note' AND authority <> 'deprecated' AND len(list_filter(symbols, lambda x: x IN ('Sym3', 'Sym7'))) > 0
)"""


def locks(rules: DataFrame) -> DataFrame:
    """(id, kind, detail, broad): rules that are locked into the pack by their scope, of which the longest path counts, or by an asked symbol."""
    c = F.col
    own = {k: c(k) for k in ("project", "module", "team", "company")}
    null = F.lit(None).cast("string")
    asked = [{"project": F.lit("src0"), "module": F.lit("en"), "team": F.lit("t3"), "company": F.lit("acme")}, {"project": F.lit("src1"), "module": null, "team": F.lit("t1"), "company": null}]
    live = rules.where("authority <> 'deprecated'")
    paths = F.filter(F.array(*[C.lock_path(c("layer"), own, q) for q in asked]), lambda p: p.isNotNull())
    longest = F.element_at(F.array_sort(F.transform(paths, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), -1)["p"]
    scoped = live.where("type = 'constraint'").withColumn("paths", paths).where(F.size("paths") > 0)
    hit = F.filter("symbols", lambda s: s.isin("Sym3", "Sym7"))
    noted = live.where("type = 'symbol_note'").withColumn("hit", hit).where(F.size("hit") > 0)
    return scoped.select("id", F.lit("constraint_scope").alias("kind"), longest.alias("detail"), (c("layer") == "company").alias("broad")).union(
        noted.select("id", F.lit("symbol_note"), F.get("hit", F.lit(0)), F.lit(False))
    )


@query(f"WITH {_LOCKED} SELECT * FROM locks")
def locked_rules(spark, sf_dir):
    return locks(cards(spark, sf_dir))


@query(f"""WITH {_LOCKED}, pairs AS (
  SELECT id, unnest(covers) AS covered, len(covers) AS n_covers, CASE freshness WHEN 'verified' THEN 4 WHEN 'unverified' THEN 3 WHEN 'needs_review' THEN 2 ELSE 1 END AS rank
  FROM cards WHERE type = 'evidence' AND authority <> 'deprecated' AND freshness <> 'potentially_superseded'
) SELECT covered AS locked_id, p.id AS evidence_id, CAST(rank AS INTEGER) AS freshness_rank, row_number() OVER (PARTITION BY covered ORDER BY rank DESC, n_covers DESC, p.id) AS place FROM pairs p JOIN locks l ON l.id = p.covered""")
def evidence_order(spark, sf_dir):
    """Evidence for each locked rule, in the order of its promotion."""
    rules = cards(spark, sf_dir)
    rank = F.when(F.col("freshness") == STATES[0], 4).when(F.col("freshness") == STATES[1], 3).when(F.col("freshness") == STATES[2], 2).otherwise(1)
    found = rules.where("type = 'evidence' and authority <> 'deprecated' and freshness <> 'potentially_superseded'")
    found = found.select(F.col("id").alias("evidence_id"), rank.alias("freshness_rank"), F.size("covers").alias("n"), F.explode("covers").alias("locked_id"))
    both = found.join(locks(rules).select(F.col("id").alias("l")), F.col("locked_id") == F.col("l"))
    place = F.row_number().over(Window.partitionBy("locked_id").orderBy(F.desc("freshness_rank"), F.desc("n"), "evidence_id"))
    return both.select("locked_id", "evidence_id", "freshness_rank", place.cast("bigint").alias("place"))


@query(f"WITH {_CARDS} SELECT coalesce(type, 'all') AS type, coalesce(freshness, 'all') AS freshness, count(*) AS n, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS manual_review FROM cards GROUP BY GROUPING SETS ((type), (freshness), ())")
def card_counts(spark, sf_dir):
    out = cards(spark, sf_dir).groupingSets([[F.col("type")], [F.col("freshness")], []], "type", "freshness").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("manual_review"))
    return out.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("freshness", F.lit("all")).alias("freshness"), "n", "manual_review")
