"""Queries about anchors, scopes, phrases, readiness, confidence and set-up. Importing this module adds them to QUERIES and ORACLES.

lineitem stands in for the slots of packs (orders), sources of documents for projects to set up, conversations for sections.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import readiness as R
from ..functions import scoring as S
from ..functions import stemmer
from ..operators import anchors, ranking
from ..sources import markdown
from ..sources.scratch import written
from .catalog import _q
from .queries import _PATH, _ALL_RANKED, _final_scores, _index, _table, query, sql_tokens

_SLOTS = """s AS (
  SELECT l_orderkey AS pack, l_linenumber AS slot, l_returnflag <> 'N' AS required, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus = 'O' END AS task_critical,
    l_linenumber = 1 AS is_missing_check, l_suppkey % 4 AS sections, l_partkey % 3 AS evidence_total, CAST(l_quantity AS BIGINT) % 4 AS evidence_found,
    l_linenumber % 3 AS scope_total, l_suppkey % 3 AS scope_found,
    CASE l_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['pdf'] ELSE ['pdf', 'sheet'] END AS expected, CASE WHEN l_suppkey % 5 = 0 THEN ['pdf'] WHEN l_suppkey % 5 = 1 THEN NULL ELSE ['pdf', 'sheet', 'mail'] END AS available,
    CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['sheet'] WHEN 2 THEN ['mail'] ELSE ['sheet', 'pdf'] END AS searched FROM lineitem
), a AS (SELECT *, len(expected) AS n_e, CASE WHEN available IS NULL THEN 0 ELSE len(list_filter(expected, lambda x: NOT list_contains(available, x))) END AS n_a,
    len(list_filter(expected, lambda x: list_contains(coalesce(searched, []), x))) AS n_s, coalesce(task_critical, required) AS critical FROM s
), b AS (SELECT *, CASE WHEN n_e > 0 THEN CASE WHEN n_s = n_e THEN 'adequate' WHEN n_s > 0 THEN 'partial' ELSE 'insufficient' END WHEN scope_total = 0 THEN 'not_applicable'
    WHEN scope_found >= scope_total THEN 'adequate' WHEN scope_found > 0 THEN 'partial' ELSE 'insufficient' END AS adequate FROM a
), c AS (SELECT *, n_e > 0 AND adequate = 'adequate' AS by_type, n_e = 0 OR adequate = 'adequate' AS types_done FROM b
), d AS (SELECT *, is_missing_check AND types_done AND ((scope_total > 0 AND scope_found >= scope_total) OR by_type) AS could_find FROM c
), e AS (SELECT *, evidence_found >= evidence_total AND types_done AND CASE WHEN is_missing_check AND evidence_total = 0 THEN could_find ELSE scope_found >= scope_total END AS complete FROM d
), f AS (SELECT *, CASE WHEN sections = 0 THEN 'empty' WHEN complete THEN 'confident' WHEN evidence_found > 0 OR scope_found > 0 THEN 'uncertain' ELSE 'weak' END AS confidence,
    CASE WHEN complete THEN 'ready' WHEN required AND n_a > 0 THEN 'blocked' WHEN required AND critical THEN 'retry_required' ELSE 'partial' END AS readiness FROM e
), g AS (SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN sections = 0 THEN 'retrieval_empty' END, CASE WHEN confidence = 'weak' THEN 'retrieval_weak' END,
    CASE WHEN evidence_found < evidence_total THEN 'required_evidence_missing' END, CASE WHEN n_a > 0 THEN 'required_source_type_unavailable' END,
    CASE WHEN scope_found < scope_total THEN 'searched_scope_incomplete' END, CASE WHEN n_e > 0 AND NOT by_type THEN 'source_type_search_incomplete' END,
    CASE WHEN could_find AND scope_total > 0 THEN 'missing_context_supported_by_searched_scope' END, CASE WHEN could_find AND by_type THEN 'missing_context_supported_by_source_type_search' END,
    CASE WHEN is_missing_check AND evidence_total = 0 AND NOT could_find THEN 'missing_context_search_unverified' END, CASE WHEN complete THEN 'all_required_support_found' END), ''), 'optional_slot_incomplete') AS reasons,
    CASE readiness WHEN 'ready' THEN 'answer' WHEN 'blocked' THEN 'ask_user' WHEN 'retry_required' THEN 'retry_slot' ELSE 'answer_with_caveat' END AS action, could_find AND complete AS finding FROM f)"""


def _slots(spark, sf_dir):
    c, text = F.col, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    part, supp, line = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    slots = _table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("pack"), line.alias("slot"), (c("l_returnflag") != "N").alias("required"), F.when(line % 3 != 0, c("l_linestatus") == "O").alias("task_critical"),
        (line == 1).alias("is_missing_check"), (supp % 4).alias("sections"), (part % 3).alias("evidence_total"), (c("l_quantity").cast("bigint") % 4).alias("evidence_found"),
        (line % 3).alias("scope_total"), (supp % 3).alias("scope_found"), F.when(part % 4 == 0, text()).when(part % 4 == 1, text("pdf")).otherwise(text("pdf", "sheet")).alias("expected"),
        F.when(supp % 5 == 0, text("pdf")).when(supp % 5 != 1, text("pdf", "sheet", "mail")).alias("available"),
        F.when(part % 5 == 1, text("sheet")).when(part % 5 == 2, text("mail")).when(part % 5 != 0, text("sheet", "pdf")).alias("searched"),
    )
    return R.slot_readiness(slots)


@query(f"WITH {_SLOTS} SELECT pack, slot, adequate, confidence, readiness, action, finding, reasons FROM g")
def slot_readiness(spark, sf_dir):
    return _slots(spark, sf_dir).select("pack", "slot", "adequate", "confidence", "readiness", "action", "finding", "reasons")


_LIST = "coalesce(string_agg(CASE WHEN {} THEN CAST(slot AS VARCHAR) END, ',' ORDER BY slot), '')"


@query(f"""WITH {_SLOTS}, p AS (SELECT pack, {_LIST.format("required AND critical AND readiness = 'blocked'")} AS blocking,
  {_LIST.format("required AND critical AND readiness IN ('retry_required', 'partial')")} AS retry, {_LIST.format("readiness = 'partial'")} AS partial, {_LIST.format("finding")} AS findings FROM g GROUP BY 1)
SELECT *, CASE WHEN blocking <> '' THEN 'blocked' WHEN retry <> '' THEN 'retry_required' WHEN partial <> '' THEN 'partial' ELSE 'ready' END AS readiness FROM p""")
def pack_readiness(spark, sf_dir):
    return R.pack_readiness(_slots(spark, sf_dir), "pack", "slot")


@query(f"""WITH {_ALL_RANKED}, m AS (SELECT item_id, count(*) AS n, max(CASE rank WHEN 1 THEN score END) AS t1, max(CASE rank WHEN 2 THEN score END) AS t2, max(CASE rank WHEN 3 THEN score END) AS t3 FROM ranked GROUP BY 1),
  q AS (SELECT item_id, coalesce(n, 0) AS n, t1, t2, t3, regexp_matches(text, {_q(I.FILE_PATH)}) AND regexp_matches(text, '[A-Za-z0-9]') AS anchored, NOT regexp_matches(text, '[A-Za-z0-9]') AS bare FROM benchmark LEFT JOIN m USING (item_id))
SELECT item_id, n AS n_ranked, CASE WHEN n = 0 THEN 'empty' WHEN bare THEN CASE WHEN t1 < 0.05 THEN 'empty' ELSE 'uncertain' END
  WHEN NOT anchored AND ((n >= 2 AND t1 - t2 < 0.12) OR (n >= 3 AND t1 - t3 < 0.15)) THEN 'uncertain' WHEN t1 >= CASE WHEN anchored THEN 0.5 ELSE 0.95 END THEN 'confident' WHEN t1 < 0.05 THEN 'empty' ELSE 'uncertain' END AS confidence FROM q""")
def coverage_confidence(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    scored = written(_final_scores(spark, sf_dir), "scores")
    first = ranking.top_per_query(scored, "item_id", 3, F.desc("score"), "doc_id").groupBy(F.col("item_id").alias("i")).agg(at(1).alias("t1"), at(2).alias("t2"), at(3).alias("t3"))
    top = scored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).join(first, F.col("item_id") == F.col("i")).drop("i")
    tasks = _table(spark, sf_dir, "benchmark").select("item_id", I.query_intent(F.col("text")).alias("intent")).join(top, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col
    said = R.result_confidence(c("n"), c("t1"), c("t2"), c("t3"), c("intent") == "file_anchored", c("intent") == "signal_empty")
    return tasks.select("item_id", c("n").alias("n_ranked"), said.alias("confidence"))


_RATE = "CASE WHEN {b} = 0 OR {a} / {b} < {low} THEN 'low' WHEN {a} / {b} < {high} THEN 'partial' ELSE 'confident' END"


@query(f"""WITH t AS (SELECT source, count(*) AS docs, count(l.doc_id) AS imported, CAST(coalesce(sum(length(text) // 2000 + 1), 0) AS BIGINT) AS chunks, count(*) FILTER (lang <> 'en') AS scoped,
    coalesce(sum(quality), 0) AS cards, coalesce(sum(toxic), 0) AS rules, count(*) FILTER (quality = 1 AND toxic = 0) AS sure FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
  b AS (SELECT source, chunks, cards % 7 = 6 AS pending, CASE WHEN chunks < 5 THEN 'low' ELSE {_RATE.format(a="imported", b="docs", low=0.3, high=0.7)} END AS corpus, {_RATE.format(a="scoped", b="docs", low=0.5, high=0.8)} AS scope,
    CASE WHEN cards = 0 THEN 'low' WHEN cards <= 5 OR rules < 1 THEN 'partial' ELSE 'confident' END AS cards, {_RATE.format(a="sure", b="imported", low=0.5, high=0.8)} AS probes FROM t)
SELECT source, chunks, corpus, scope, cards, probes, CASE WHEN pending THEN 'review_inbox' WHEN corpus = 'confident' AND scope = 'confident' AND cards = 'confident' AND probes = 'confident' THEN 'all_confident'
  WHEN cards = 'low' AND chunks >= 50 AND scope <> 'low' THEN 'bootstrap_despite_low_corpus' WHEN corpus = 'low' THEN 'import_more_docs' WHEN cards = 'low' THEN 'bootstrap_cards' WHEN scope = 'low' THEN 'fix_scope_layer'
  WHEN probes = 'low' THEN 'tune_retrieval' ELSE 'validate_with_context' END AS next_step FROM b""")
def setup_bands(spark, sf_dir):
    """Each source as a project: labelled documents count as imported, other languages than English as scoped."""
    c, count = F.col, lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.floor(F.length("text") / 2000) + 1).alias("parts"))
    labels = _table(spark, sf_dir, "labels").select(c("doc_id").alias("labelled"), "quality", "toxic")
    t = docs.join(labels, c("doc_id") == c("labelled"), "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count("labelled").alias("imported"), F.coalesce(F.sum("parts"), F.lit(0)).alias("chunks"), count(c("lang") != "en").alias("scoped"),
        F.coalesce(F.sum("quality"), F.lit(0)).alias("n_cards"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("rules"), count((c("quality") == 1) & (c("toxic") == 0)).alias("sure"),
    )
    t = t.withColumns({"corpus": R.corpus_band(c("imported"), c("docs"), c("chunks")), "scope": R.band(c("scoped"), c("docs"), "scope"), "cards": R.card_band(c("n_cards"), c("rules")), "probes": R.band(c("sure"), c("imported"), "probes")})
    step = R.next_step(c("n_cards") % 7 == 6, c("corpus"), c("scope"), c("cards"), c("probes"), c("chunks"))
    return t.select("source", "chunks", "corpus", "scope", "cards", "probes", step.alias("next_step"))


@query(f"""WITH idx AS (SELECT doc_id, field, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, 'title' AS field, {sql_tokens("source")} AS t FROM documents UNION ALL SELECT doc_id, 'body', {sql_tokens("text")} FROM documents)),
  q AS (SELECT item_id, list_distinct(list_reverse({sql_tokens("text")})) AS d, list_filter({sql_tokens("text")}, lambda x, i: list_position({sql_tokens("text")}, x) = i) AS t FROM benchmark)
SELECT DISTINCT item_id, a.doc_id FROM q JOIN idx a ON a.term = t[len(t) - 1] JOIN idx b ON b.term = t[len(t)] AND a.doc_id = b.doc_id AND a.field = b.field AND a.pos + 1 = b.pos WHERE len(t) > 1""")
def phrase_boost(spark, sf_dir):
    """Documents that gain from the query's last two terms side by side."""
    from ..functions import text as T

    terms = _table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokenize(F.col("text"))).alias("t")).where(F.size("t") > 1)
    tails = terms.select("item_id", F.element_at("t", -2).alias("first"), F.element_at("t", -1).alias("last"))
    return anchors.phrase_hits(_index(spark, sf_dir), tails, "doc_id", "item_id")


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), a AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS anchor FROM p WHERE contains(path, '/'))
SELECT anchor, count(*) AS n, min(path) AS first FROM a JOIN p ON path = anchor OR (contains(anchor, '/') AND ends_with(path, '/' || anchor)) OR (contains(path, '/') AND ends_with(anchor, '/' || path)) WHERE anchor <> '' GROUP BY 1""")
def file_suffix_join(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    paths = _table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    given = paths.where(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "^[^/]*/", "").alias("anchor")).where("anchor <> ''").distinct()
    return anchors.file_suffix_matches(given, paths).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


SCOPES = [{"module": "fr", "team": "src1"}, {"project": "src7"}, {"company": "en"}, {"project": "src16", "module": "de"}]


@query("""SELECT doc_id, greatest(0.0, CASE WHEN lang = 'fr' THEN 1.0 END, CASE WHEN source = 'src1' THEN 0.3 END, CASE WHEN source = 'src7' THEN 0.6 END, CASE WHEN lang = 'en' THEN 0.3 END, CASE WHEN source = 'src16' THEN 0.6 END, CASE WHEN lang = 'de' THEN 1.0 END)::DOUBLE AS scope FROM documents""")
def scope_match(spark, sf_dir):
    levels = {"module": F.col("lang"), "project": F.col("source"), "team": F.col("source"), "company": F.col("lang")}
    return _table(spark, sf_dir, "documents").select("doc_id", anchors.scope_match(levels, SCOPES).alias("scope"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, round(0.7 / (1 + turn) * CASE role WHEN 'user' THEN 1.4 WHEN 'assistant' THEN 1.2 ELSE 0.9 END * CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - 0.15 * (i - 1) / (n - 1) END * CASE WHEN n > 15 THEN 0.85 ELSE 1.0 END, 6) AS score FROM t""")
def section_score(spark, sf_dir):
    """The chunk score's factors for layer, place and number of parts, over turns as sections."""
    turns = anchors.renumber(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    layer = F.when(F.col("role") == "user", S.SPECIFICITY["symbol"]).when(F.col("role") == "assistant", S.SPECIFICITY["feature"]).otherwise(S.SPECIFICITY["company"])
    factor = layer * S.position_decay(F.col("place"), F.col("siblings"))
    return turns.select("conv_id", "turn", F.round(S.final_score(1.0 / (1 + F.col("turn")), factor=factor, chunk_count=F.col("siblings")), 6).alias("score"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), d AS (SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS section, path FROM p)
SELECT page_id, section, row_number() OVER w AS place, count(*) OVER (PARTITION BY section) AS siblings, row_number() OVER w = 1 AS landing FROM d WINDOW w AS (PARTITION BY section ORDER BY path, page_id)""")
def nav_renumber(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    pages = _table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("section", F.regexp_replace("path", "/?[^/]*$", ""))
    return anchors.renumber(pages, "section", "path", "page_id").select("page_id", "section", F.col("place").cast("bigint").alias("place"), "siblings", "landing")


@query("""WITH o AS (SELECT user_id, event_id, ts, coalesce(CAST(date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000 AS INTEGER), 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM o) SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY 1, 2""")
def gap_runs(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    runs = anchors.gap_groups(events, "user_id", F.unix_micros("ts"), 3_600_000_000, "event_id")
    return runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH a AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 150000 GROUP BY 1), b AS (SELECT o_custkey, min(o_orderstatus) AS s FROM orders WHERE o_totalprice < 200000 GROUP BY 1)
SELECT coalesce(a.s, 'absent') AS before, coalesce(b.s, 'absent') AS after, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE coalesce(a.s, 'absent') <> coalesce(b.s, 'absent') GROUP BY 1, 2""")
def freshness_transitions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    a = orders.where("o_totalprice > 150000").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"))
    b = orders.where("o_totalprice < 200000").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("s"))
    return anchors.transitions(a, b, "o_custkey", "s")


@query()
def stemmed_df(spark, sf_dir):
    """Document frequency of each stem. Terms are counted, and written, before the distinct ones are stemmed."""
    terms = written(_index(spark, sf_dir).select("doc_id", "term").distinct(), "terms")
    return stemmer.with_stems(terms.repartition("doc_id")).select("doc_id", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("df"))


@query()
def stemmed_bm25(spark, sf_dir):
    """The fielded ranking over stems, of tasks and documents alike."""
    docs = _index(spark, sf_dir)
    index = written(docs.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("n")), "terms")
    index = stemmer.with_stems(index.repartition("doc_id")).select("doc_id", "field", F.col("stem").alias("term"), F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    asked = stemmer.with_stems(ranking.query_terms(_table(spark, sf_dir, "benchmark"), "item_id", "text")).select("item_id", F.col("stem").alias("term")).distinct()
    n = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return ranking.bm25(index, asked.join(n, "item_id"), "doc_id", "item_id").select("item_id", "doc_id", "matched", F.round("raw", 6).alias("raw"), F.round("bm25", 6).alias("bm25"))


@query()
def markdown_sections(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("title", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    return markdown.sections(docs, "doc_id", "text", "title")
