"""More core queries: identifiers, rules, layout, topology, ranks, reports. Importing this module adds them to QUERIES and ORACLES."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import paths as P
from .queries import _PATH, _ALL_RANKED, _ranked, _table, query


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SEEN_ID = " AND ".join([
    "length(x) BETWEEN 5 AND 40", f"regexp_matches(x, {_q(I.SHAPE)})", "regexp_matches(x, '[A-Za-z]')", "regexp_matches(x, '[0-9][^0-9]*[0-9]')",
    f"(regexp_matches(x, '[-/#]') OR regexp_matches(x, {_q(I.UNSEPARATED)}))", *[f"NOT regexp_matches(x, {_q(p)})" for p in (I.ISO_TIME, I.PROSE_YEAR, I.QUANTITY)],
    f"NOT (regexp_matches(x, {_q(I.MONTH_DATE)}) AND regexp_matches(x, {_q(I.MONTH_SEGMENT)}))",
])


@query(rf"""WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), {_q(I.RUN)}), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: {_SEEN_ID}) AS t FROM documents),
  l AS (SELECT doc_id, t, list_transform(t, lambda x: lower(x)) AS w FROM r), d AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(w, lower(x)) = i) AS ids FROM l)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS ids FROM d""")
def id_mentions(spark, sf_dir):
    ids = _table(spark, sf_dir, "documents").select("doc_id", I.id_tokens(F.col("text")).alias("i"))
    return ids.select("doc_id", F.size("i").alias("n_ids"), F.array_join("i", " ").alias("ids"))


_NOISE = " OR ".join([f"regexp_matches(s, {_q(I.GLOSSARY)})", *[f"starts_with(s, '{p}')" for p in I.BOT_PREFIXES]])


@query(rf"""WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents),
  p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(s, '^[-*]\s+', ''), '^[0-9]+\.\s+', '')) AS s FROM c),
  k AS (SELECT doc_id, s, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS rule_key FROM p WHERE length(s) BETWEEN 20 AND 240 AND (regexp_matches(s, {_q(I.STRONG)}) OR regexp_matches(s, {_q(I.WEAK)})) AND NOT ({_NOISE}))
SELECT rule_key, count(DISTINCT doc_id) AS support, min(doc_id) AS first_doc, bool_or(regexp_matches(s, {_q(I.STRONG)})) AS strong, 'cand-' || substr(sha256(rule_key), 1, 10) AS candidate FROM k GROUP BY 1""")
def rule_mining(spark, sf_dir):
    """Sentences that state a rule, one row for each wording, with the number of documents that have it."""
    s = _table(spark, sf_dir, "documents").select("doc_id", F.explode(I.sentences(F.col("text"))).alias("s")).where(I.is_rule(F.col("s")))
    one = s.select("doc_id", I.rule_key(F.col("s")).alias("rule_key"), F.col("s").rlike(I.STRONG).alias("strong")).groupBy("rule_key", "doc_id").agg(F.bool_or("strong").alias("strong"))
    out = one.groupBy("rule_key").agg(F.count(F.lit(1)).alias("support"), F.min("doc_id").alias("first_doc"), F.bool_or("strong").alias("strong"))
    return out.withColumn("candidate", F.concat(F.lit("cand-"), F.substring(F.sha2("rule_key", 256), 1, 10)))


_RATIO = r"(length(regexp_replace(x, '[A-Za-z0-9\s]', '', 'g')) / length(x))"
_BAD = f"(regexp_matches(x, {_q(I.SUSPICIOUS)}) OR (NOT regexp_matches(x, {_q(I.TABLE_RULE)}) AND (regexp_matches(x, {_q(I.SUSPICIOUS_SHAPE)}) OR (length(x) > 30 AND {_RATIO} > 0.45))))"
_MARKS = f"(length(x) <= 18)::INT + ({_RATIO} > 0.35)::INT + (regexp_matches(x, {_q(I.CAPS)}) AND length(x) <= 80)::INT + regexp_matches(x, {_q(I.ISOLATED)})::INT + {_BAD}::INT"


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, round(CASE WHEN len(t) > 0 THEN list_sum(list_transform(t, lambda x: {_MARKS})) / len(t) ELSE 0 END, 6) AS layout_risk FROM l""")
def layout_risk(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(I.layout_risk(F.col("text")), 6).alias("layout_risk"))


@query(f"""SELECT item_id, CASE WHEN NOT regexp_matches(text, '[A-Za-z0-9]') THEN 'signal_empty' WHEN regexp_matches(text, {_q(I.FILE_PATH)}) THEN 'file_anchored'
  WHEN regexp_matches(text, {_q(I.DECISION)}) THEN 'decision_lookup' WHEN regexp_matches(text, {_q(I.SYMBOL)}) THEN 'exact_symbol' ELSE 'broad_domain' END AS intent FROM benchmark""")
def query_intent(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", I.query_intent(F.col("text")).alias("intent"))


_STRIPPED = _PATH
for _p in (r"\./", "src/", "lib/", "tests/", "test/", "spec/", "specs/", "docs/", "doc/"):
    _STRIPPED = f"regexp_replace({f'lower({_STRIPPED})' if _STRIPPED == _PATH else _STRIPPED}, '^{_p}', '')"


@query(f"SELECT page_id, {_STRIPPED} AS file FROM pages")
def normalized_files(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", I.normalized_file(path).alias("file"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path, CAST(length(html) AS DOUBLE) / 1000 AS score FROM pages),
  up AS (SELECT lower(array_to_string(string_split(path, '/')[1:i], '/')) AS dir, max(score) AS best FROM p, range(1, 40) t(i) WHERE i < len(string_split(path, '/')) GROUP BY 1)
SELECT page_id, round(score + CASE WHEN best IS NULL THEN 0 ELSE 0.15 * least(score, best) END, 6) AS score, best IS NOT NULL AS landing FROM p LEFT JOIN up ON lower(regexp_replace(path, '\\.[^./]+$', '')) = dir""")
def hierarchy_inheritance(spark, sf_dir):
    """A section's landing page gains by its best page; pages meet their directories by an equi-join."""
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    pages = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (F.length("html").cast("double") / 1000).alias("score"))
    above = pages.where(F.contains("path", F.lit("/"))).select(F.explode(P.ancestors(F.col("path"))).alias("dir"), "score")
    best = above.groupBy(F.lower("dir").alias("dir")).agg(F.max("score").alias("best"))
    joined = pages.join(best, F.lower(F.regexp_replace("path", r"\.[^./]+$", "")) == F.col("dir"), "left")
    gain = F.coalesce(0.15 * F.least("score", F.col("best")), F.lit(0.0))
    return joined.select("page_id", F.round(F.col("score") + F.when(F.col("best").isNull(), 0.0).otherwise(gain), 6).alias("score"), F.col("best").isNotNull().alias("landing"))


@query(f"""WITH {_ALL_RANKED} SELECT item_id, max(CASE rank WHEN 1 THEN score END) AS top1, round(max(CASE rank WHEN 1 THEN score END) - max(CASE rank WHEN 2 THEN score END), 6) AS margin12,
  round(max(CASE rank WHEN 1 THEN score END) - max(CASE rank WHEN 3 THEN score END), 6) AS margin13 FROM ranked GROUP BY 1""")
def adjacent_margins(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return _ranked(spark, sf_dir, 3).groupBy("item_id").agg(at(1).alias("top1"), F.round(at(1) - at(2), 6).alias("margin12"), F.round(at(1) - at(3), 6).alias("margin13"))


@query(f"""WITH {_ALL_RANKED}, s AS (SELECT item_id, source, dense_rank() OVER (PARTITION BY item_id ORDER BY min(rank)) AS source_rank FROM ranked GROUP BY 1, 2)
SELECT item_id, doc_id, source_rank * 100 + row_number() OVER (PARTITION BY item_id, source ORDER BY rank) - 1 AS priority FROM ranked JOIN s USING (item_id, source)""")
def source_priority(spark, sf_dir):
    top = _ranked(spark, sf_dir).withColumn("first", F.min("rank").over(Window.partitionBy("item_id", "source")))
    order = F.dense_rank().over(Window.partitionBy("item_id").orderBy("first"))
    place = F.row_number().over(Window.partitionBy("item_id", "source").orderBy("rank"))
    return top.select("item_id", "doc_id", (order * 100 + place - 1).cast("bigint").alias("priority"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def current_version(spark, sf_dir):
    """The latest version of each key, by a partial aggregate and no sort."""
    last = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("v"))
    return last.select("o_custkey", "v.o_orderkey", "v.o_orderdate")


@query("""SELECT l_returnflag AS before, l_linestatus AS after, count(*) AS n FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY 1, 2""")
def state_transitions(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").where("l_returnflag <> l_linestatus").groupBy(F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT source, avg(quality) AS r FROM labels JOIN documents USING (doc_id) GROUP BY 1), b AS (SELECT source, avg(quality) AS r FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, round(a.r, 6) AS base, round(b.r, 6) AS now, round(b.r - a.r, 6) AS delta FROM a FULL JOIN b ON a.source = b.source""")
def baseline_deltas(spark, sf_dir):
    """Rates of one report against another's; the second is the first's for English only."""
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    rate = lambda df, s, r: df.groupBy(F.col("source").alias(s)).agg(F.avg("quality").alias(r))
    joined = rate(both, "s", "a").join(rate(both.where("lang = 'en'"), "t", "b"), F.col("s") == F.col("t"), "full")
    return joined.select(F.coalesce("s", "t").alias("source"), F.round("a", 6).alias("base"), F.round("b", 6).alias("now"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS kind, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def inbox_totals(spark, sf_dir):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    out = _table(spark, sf_dir, "orders").groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("kind"), "n")


PART_TOKENS = 400


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CAST(ceil(length(x) / 4) AS INTEGER)) AS c FROM documents), f AS (
  SELECT doc_id, c, 1 AS i, 1 AS part, c[1] AS used FROM t
  UNION ALL SELECT doc_id, c, i + 1, CASE WHEN used > 0 AND used + c[i + 1] > {PART_TOKENS} THEN part + 1 ELSE part END, CASE WHEN used > 0 AND used + c[i + 1] > {PART_TOKENS} THEN c[i + 1] ELSE used + c[i + 1] END
  FROM f WHERE i < len(c)) SELECT doc_id, part AS parts, used AS last_tokens FROM f WHERE i = len(c)""")
def section_parts(spark, sf_dir):
    """Greedy parts of at most PART_TOKENS tokens out of whole lines: a sum that starts again, so a fold and no window."""
    costs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.ceil(F.length(x) / 4).cast("int"))

    def step(s, c):
        full = (s["used"] > 0) & (s["used"] + c > PART_TOKENS)
        return F.struct((s["part"] + full.cast("int")).alias("part"), F.when(full, c).otherwise(s["used"] + c).alias("used"))

    fold = F.aggregate(costs, F.struct(F.lit(1).alias("part"), F.lit(0).alias("used")), step)
    return _table(spark, sf_dir, "documents").select("doc_id", fold.alias("f")).select("doc_id", F.col("f.part").alias("parts"), F.col("f.used").alias("last_tokens"))
