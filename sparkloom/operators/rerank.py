"""Sources of a query ranked anew by a fixed linear model over what their profiles say.

Candidates are the first sources of each query (a top-k, see selection.TOP_SOURCES), one row each, so what is gathered by query is bounded. Tokens match by classes of
equal meaning, or when a long target contains the query's token. Which tokens match is found once for each pair of distinct tokens:
targets meet query tokens by their runs of five characters, an equi-join, and then are checked; the rows of candidates only intersect arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scoring import rounded
from ..functions.text import coverage, tokenize
from ..sources.scratch import written

# Classes of tokens with equal meaning (stems), and how long tokens are that match inside longer ones.
CLASSES = (
    ("auth", "authent", "author", "authoriz"),
    ("cli", "command", "line", "interfac"),
    ("rpc", "jsonrpc", "json_rpc"),
    ("i18n", "intern", "languag", "locale", "local", "translat"),
    ("chain", "compo", "compos", "pipe", "pipelin"),
    ("either", "tag", "union"),
)
COMPOUND, LONGER = 5, 3
# Tokens that say nothing about what a query is after, that ask for an overview, that name overviews and broad pages.
NOISE = (
    "what", "how", "why", "which", "when", "where", "who", "choo", "use", "us", "set", "setup", "up", "config", "configur", "run", "read", "write", "creat", "add", "enabl",
    "manag", "control", "protect", "check", "handl", "wire", "work", "singl", "multipl", "on", "one", "file", "test", "api", "json", "ts", "js",
)
OVERVIEW_ASKED = ("overview", "intro", "introduct", "explain", "concept", "basic", "orient", "understand", "pictur", "primer", "guid")
OVERVIEW_NAMES = ("overview", "intro", "introduct", "readm", "index", "start")
BROAD_NAMES = ("index", "readm", "overview", "config", "configur", "configuration", "api", "refer", "reference", "feature", "advanced")
LANDINGS = ("index", "readme", "overview")
MIGRATION = (
    r"(?i)\b(migrate|migration|migrating|migrat|upgrade|upgrading|upgrad|adopt|adopting|adoption|moving\s+(?:\w+\s+){0,6}onto|version|versions|breaking|break|deprecate|deprecated"
    r"|deprecation|deprecat|changelog|release|releas|release[- ]?notes?)\b"
)
VERSION = r"(?i)^v?\d+(\.\d+)*$"
RELEASES = ("migration", "changelog", "release_note")
# What a purpose is worth for an intent.
PURPOSE_FITS = {
    "decision_lookup": {"adr": 0.30, "concept": 0.20, "runbook": 0.15, "prd": 0.15, "guide": 0.10},
    "exact_symbol": {"api_reference": 0.30, "package_readme": 0.15, "readme": 0.10, "guide": 0.05, "concept": 0.05},
    "broad_domain": {"concept": 0.25, "quick_start": 0.25, "guide": 0.20, "readme": 0.15, "package_readme": 0.10, "api_reference": 0.05},
    "file_anchored": {"api_reference": 0.20, "guide": 0.15, "runbook": 0.10, "concept": 0.05},
}
# The weights of the model, and the share of its best page that a landing page inherits.
WEIGHTS = {
    "chunk_score": 0.62, "rank_prior": 0.08, "title": 0.28, "path": 0.30, "title_path": 0.20, "heading": 0.05, "filename": 0.18, "intro": 0.05,
    "alias_hits": 0.025, "owner": 0.72, "overview": 0.65, "purpose_fit": 0.35,
}
ALIAS_HITS, SEGMENT_BOOST, INHERITED = 4, 0.30, 0.15
#: Kinds of aliases that name a source itself.
IDENTITY = ("filename", "path", "title", "package", "symbol", "route")
#: What a profile shows.
SURFACES = ("title", "path", "file", "heading", "intro", "alias")


def class_of(token: Column) -> Column:
    """The first token of its class, or itself."""
    out = token
    for names in CLASSES:
        out = F.when(token.isin(*names), F.lit(names[0])).otherwise(out)
    return out


def equivalents(token: Column) -> Column:
    """array<string>: the tokens of its class, or itself alone."""
    out = F.array(token)
    for names in CLASSES:
        out = F.when(token.isin(*names), F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def owner_tokens(tokens: Column) -> Column:
    """The query's distinct tokens with all of their classes, without noise unless there is nothing else."""
    every = F.array_distinct(F.flatten(F.transform(tokens, equivalents)))
    some = F.filter(every, lambda t: ~t.isin(*NOISE))
    return F.when(F.size(some) > 0, some).otherwise(every)


def token_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(token, forms): for each distinct token of asked, the tokens of known that match it. Both have a column token.

    A token matches those of its class, and those of which an equivalent is at least LONGER characters longer than one of its own of COMPOUND characters or more and contains it.
    """
    asked, known = (df.select("token").where(F.col("token").isNotNull()).distinct() for df in (asked, known))
    same = asked.withColumn("class", class_of(F.col("token"))).join(known.select(F.col("token").alias("form"), class_of(F.col("token")).alias("class")), "class").select("token", "form")
    part = asked.select("token", F.explode(equivalents(F.col("token"))).alias("part")).where(F.length("part") >= COMPOUND)
    whole = known.select(F.col("token").alias("form"), F.explode(equivalents(F.col("token"))).alias("whole")).where(F.length("whole") >= COMPOUND + LONGER)
    runs = F.transform(F.sequence(F.lit(1), F.length("whole") - COMPOUND + 1), lambda i: F.substring(F.col("whole"), i, F.lit(COMPOUND)))
    keyed = whole.withColumn("run", F.explode(F.array_distinct(runs)))
    inside = part.withColumn("run", F.substring("part", 1, COMPOUND)).join(keyed, "run").where((F.length("whole") >= F.length("part") + LONGER) & F.contains("whole", F.col("part")))
    return same.union(inside.select("token", "form")).groupBy("token").agg(F.collect_set("form").alias("forms"))


def surfaces(candidates: DataFrame, stems=lambda tokens: tokens) -> DataFrame:
    """candidates with the token arrays of what their profiles show; stems turns an array of tokens into one of stems."""
    c = F.col
    split = lambda text: stems(tokenize(text))
    whole = lambda text: stems(tokenize(text, split_identifiers=False))
    named = F.coalesce(c("title"), F.lit(""))
    joined = lambda texts: F.array_join(texts, " \n ")
    pairs = F.transform("aliases", lambda a: F.struct(a["kind"].alias("kind"), a["value"].alias("value")))
    aliases = F.coalesce(pairs, F.array().cast("array<struct<kind:string,value:string>>"))
    values = lambda kinds: F.transform(F.filter(aliases, lambda a: a["kind"].isin(*kinds)) if kinds else aliases, lambda a: a["value"])
    heads = F.coalesce(c("headings"), F.array().cast("array<string>"))
    parent = F.regexp_extract(c("source"), r"([^/\\]+)[/\\]+[^/\\]*$", 1)
    return candidates.select(
        "*", split(named).alias("title_split"), split(c("source")).alias("path_split"), split(joined(heads)).alias("heading_split"), split(joined(values(()))).alias("alias_split"),
        split(paths.stem(c("source"))).alias("leaf_split"), whole(named).alias("title_whole"), whole(c("source")).alias("path_whole"), whole(paths.stem(c("source"))).alias("file_whole"),
        whole(joined(heads)).alias("heading_whole"), whole(c("intro")).alias("intro_whole"), whole(joined(values(IDENTITY))).alias("alias_whole"), whole(c("h1")).alias("h1_whole"),
        whole(joined(values(()))).alias("every_alias"), whole(parent).alias("parent_whole"),
    )


def _weights(shown: DataFrame, query: str) -> DataFrame:
    """(query, asks): the query's owner tokens in order with what they match and their weight: how few of its candidates have them."""
    c = F.col
    structural = F.array_distinct(F.concat("path_whole", "file_whole", "title_whole", "h1_whole", "intro_whole", "heading_whole", "every_alias"))
    asked = shown.groupBy(query).agg(F.first("owner_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    every = asked.select(query, "n", F.posexplode("t").alias("at", "token"))
    known = shown.select(F.explode(F.array_distinct(F.concat(structural, F.col("alias_whole")))).alias("token"))
    forms = token_matches(every, known).withColumnRenamed("token", "w")
    every = every.join(forms, c("token") == c("w"), "left").drop("w").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))
    asks = every.groupBy(query, "n").agg(F.sort_array(F.collect_list(F.struct("at", "token", "forms"))).alias("asks")).withColumnRenamed(query, "__query")
    met = shown.select(query, structural.alias("tokens")).join(asks, c(query) == c("__query"))
    hit = met.select("__query", F.explode(F.filter(F.transform("asks", lambda a: F.when(F.arrays_overlap(a["forms"], c("tokens")), a["at"])), lambda x: x.isNotNull())).alias("k"))
    df = hit.groupBy("__query", "k").agg(F.count(F.lit(1)).alias("df")).groupBy(F.col("__query").alias("dq")).agg(F.map_from_entries(F.collect_list(F.struct("k", "df"))).alias("dfs"))
    raw = lambda n, df: F.when(df == 0, 0.55).otherwise(0.20 + F.log((n + 1.0) / (df + 1.0)) / F.greatest(F.log(n + 1.0), F.lit(1e-6)))
    weighed = asks.join(df, c("__query") == c("dq"), "left")

    def weigh(a: Column) -> Column:
        found = F.coalesce(F.try_element_at(c("dfs"), a["at"]), F.lit(0))
        return F.struct(a["token"].alias("token"), a["forms"].alias("forms"), F.greatest(F.lit(0.18), F.least(F.lit(1.0), raw(c("n"), found))).alias("weight"))

    return weighed.select("__query", F.transform("asks", weigh).alias("asks"))


def _hits(tokens: Column) -> Column:
    return F.filter(F.col("asks"), lambda a: F.arrays_overlap(a["forms"], tokens))


def _covered(tokens: Column) -> Column:
    """Weight of the query's tokens that are there, over how many tokens there are."""
    total = F.aggregate(_hits(tokens), F.lit(0.0), lambda s, a: s + a["weight"])
    return F.when((F.size("asks") > 0) & (F.size(tokens) > 0), total / F.size("asks")).otherwise(0.0)


def _strongest(tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_hits(tokens), lambda a: a["weight"])), F.lit(0.0))


def _any(tokens: Column, names: tuple[str, ...]) -> Column:
    return F.exists(tokens, lambda t: t.isin(*names))


def asks_migration(tokens: Column) -> Column:
    return F.array_join(tokens, " ").rlike(MIGRATION) | (F.array_contains(tokens, "move") & F.exists(tokens, lambda t: t.rlike(VERSION)))


def asks_overview(tokens: Column, owner: Column) -> Column:
    what = F.array_contains(tokens, "what")
    return _any(tokens, OVERVIEW_ASKED) | (F.array_contains(tokens, "how") & F.array_contains(tokens, "work")) | (what & (F.size(owner) <= 1))


def _segment_hit(segment: Column, tokens: Column, stems) -> Column:
    low = F.lower(segment)
    parts = F.filter(F.split(low, "[-_.]+"), lambda p: p != "")
    forms = F.concat(F.array(low), parts, stems(F.flatten(F.transform(parts, lambda p: tokenize(p)))))
    return segment.isNotNull() & F.arrays_overlap(forms, tokens)


def features(candidates: DataFrame, query: str, stems=lambda tokens: tokens) -> DataFrame:
    """candidates with the features of the model and their score.

    candidates: query, source, tokens (of the query, in order), intent, chunk_score, chunk_rank, fused_rank (or null), and of the profile title, h1, intro, headings, aliases,
    purpose, role, token_count, chunk_count, package_segment, version_segment; title is null where a source has no profile.
    """
    c = F.col
    # Written, as several steps read them: first the candidates, then their tokens, then what their tokens cover.
    shown = surfaces(written(candidates, "candidates"), stems).withColumn("owner_tokens", owner_tokens(c("tokens"))).withColumn("has_profile", c("title").isNotNull())
    shown = written(shown, "surfaces")
    out = shown.join(_weights(shown, query), c(query) == c("__query")).drop("__query")
    for s in SURFACES:
        out = out.withColumn(f"own_{s}", _covered(c(f"{s}_whole")))
    strong = {s: _strongest(c(f"{s}_whole")) for s in ("file", "title", "path")}
    out = out.withColumns({f"strong_{s}": v for s, v in strong.items()})
    flat = {"title": "title_split", "path": "path_split", "heading": "heading_split"}
    out = out.withColumns({f"in_{s}": coverage(c("tokens"), c(col)) for s, col in flat.items()})
    out = out.withColumn("title_path", F.least("in_title", "in_path")).withColumn("rank_prior", 1 / F.sqrt(F.greatest(F.when(c("fused_rank") > 0, c("fused_rank")).otherwise(c("chunk_rank")), F.lit(1))))
    out = written(out.withColumn("alias_hits", F.size(F.filter("tokens", lambda t: F.array_contains("alias_split", t)))), "covered")
    # Whom the query's tokens name: identity by the best surface, support by headings and introduction, more where several agree.
    identity = F.greatest("own_file", c("own_title") * 0.9, c("own_path") * 0.78, c("own_alias") * 0.72, F.greatest(c("strong_file"), c("strong_title") * 0.9, c("strong_path") * 0.75) * 0.82)
    support = F.greatest(c("own_heading") * 0.22, c("own_intro") * 0.25)
    count = lambda names: sum((c(f"own_{n}") >= 0.20).cast("int") for n in names)
    names, backs = count(("file", "title", "path", "alias")), count(("heading", "intro"))
    bonuses = (F.when(names >= 2, 0.10).otherwise(0.0), F.when((names >= 1) & (backs >= 1), 0.08).otherwise(0.0), F.when((c("intent") == "file_anchored") & (c("own_file") > 0) & (names >= 2), 0.10).otherwise(0.0))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    leaf = F.lower(paths.stem(c("source")))
    landing = leaf.isin(*LANDINGS) | (c("has_profile") & (_any(c("title_whole"), OVERVIEW_NAMES) | _any(c("parent_whole"), OVERVIEW_NAMES)))
    topic = F.greatest("own_title", "own_path", "own_heading", "own_intro", "own_alias")
    overview = unit(0.52 + topic * 0.35 + F.when(leaf.isin("overview", "readme"), 0.10).otherwise(0.0) + F.when(F.size("owner_tokens") <= 1, 0.10).otherwise(0.0))
    out = out.withColumn("owner", unit(sum(bonuses, identity + support))).withColumn("overview", F.when(asks_overview(c("tokens"), c("owner_tokens")) & landing & (topic > 0), overview).otherwise(0.0))
    # What a page is for, against what is asked.
    moves, purpose, intent = asks_migration(c("tokens")), c("purpose"), c("intent")
    fit = F.lit(0.0)
    for kind, table in PURPOSE_FITS.items():
        for name, worth in table.items():
            fit = F.when((intent == kind) & (purpose == name), worth).otherwise(fit)
    fit = F.when(moves & purpose.isin(*RELEASES), F.greatest(fit, F.lit(0.30))).otherwise(fit)
    astray = F.when(purpose.isin(*RELEASES) & ~moves, -0.20).otherwise(0.0) - F.when((purpose == "api_reference") & (intent == "decision_lookup"), 0.10).otherwise(0.0)
    known = lambda x: F.when(c("has_profile"), F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("purpose_fit", known(fit)).withColumn("astray", known(astray))
    named, backed = F.greatest("own_file", "own_title", "own_path", "own_alias"), F.greatest("own_heading", "own_intro")
    broad = _any(c("leaf_split"), BROAD_NAMES) | _any(c("title_split"), BROAD_NAMES)
    by_heads = (backed >= 0.20) & (named < 0.15)
    large = (c("token_count") >= 2500) | (c("chunk_count") >= 15)
    container = (
        F.when(by_heads & large, F.when(intent == "file_anchored", -0.22).otherwise(-0.15)).otherwise(0.0) + F.when(by_heads & broad, -0.12).otherwise(0.0)
        + F.when((purpose == "api_reference") & intent.isin("broad_domain", "file_anchored") & (named < 0.35), -0.10).otherwise(0.0) + F.when(broad & (named < 0.20) & (backed > 0), -0.08).otherwise(0.0)
    )
    out = out.withColumn("container", F.when(c("has_profile") & (c("overview") <= 0.5), F.greatest(container, F.lit(-0.42))).otherwise(0.0))
    own = F.filter(F.concat("title_whole", "file_whole"), lambda t: ~t.isin(*NOISE))
    classes = F.transform("owner_tokens", class_of)
    others = F.exists(own, lambda t: ~F.array_contains(classes, class_of(t)))
    narrow = (
        intent.isin("broad_domain", "decision_lookup") & ~leaf.isin(*LANDINGS) & (F.greatest("strong_file", "strong_title") <= 0) & (c("own_path") >= 0.20)
        & (F.greatest("own_title", "own_file") < 0.35) & others
    )
    out = out.withColumn("narrow", F.when(narrow, -0.10).otherwise(0.0)).withColumn("role_cost", F.when(c("role") == "archive", -0.15).when(c("role") == "ideation", -0.05).otherwise(0.0))
    boost = sum(F.when(c("has_profile") & _segment_hit(c(s), c("tokens"), stems), SEGMENT_BOOST).otherwise(0.0) for s in ("package_segment", "version_segment"))
    out = out.withColumn("topology", boost)
    parts = {
        "chunk_score": c("chunk_score"), "rank_prior": c("rank_prior"), "title": c("in_title"), "path": c("in_path"), "title_path": c("title_path"), "heading": c("in_heading"), "filename": c("own_file"),
        "intro": c("own_intro"), "alias_hits": F.least(c("alias_hits"), F.lit(ALIAS_HITS)), "owner": c("owner"), "overview": c("overview"), "purpose_fit": c("purpose_fit"),
    }
    score = sum(parts[k] * w for k, w in WEIGHTS.items()) + c("astray") + c("container") + c("narrow") + c("role_cost") + c("topology")
    return written(out.withColumn("score", score).drop("asks", *[x for x in out.columns if x.endswith(("_whole", "_split"))], "every_alias"), "scored")


def landing_dir(source: Column) -> Column:
    """The folder, with a slash, that a page is the landing page of: its own for index and README in a folder, else the one of its name; null for other files."""
    index = F.regexp_extract(source, r"(?i)^(.*/)(?:index|README)\.(?:md|mdx)$", 1)
    named = F.regexp_extract(source, r"(?i)^(.+)\.(?:md|mdx)$", 1)
    return F.when(index != "", index).when(named != "", F.concat(named, F.lit("/")))


def inherited(scored: DataFrame, query: str) -> DataFrame:
    """(query, source, score): landing pages gain INHERITED of the lesser of their own score and their best page's. Pages are taken in the order of chunk_rank
    and source, so that a page's gain counts for those after it; a query's candidates are few, and their scores one array."""
    c = F.col
    row = F.struct("chunk_rank", "source", "score", landing_dir(c("source")).alias("dir"))
    sets = scored.groupBy(query, "intent").agg(F.sort_array(F.collect_list(row)).alias("set"))
    children = lambda p: F.filter(F.sequence(F.lit(0), F.size("set") - 1), lambda j: F.startswith(F.get(c("set"), j)["source"], p["dir"]) & (F.get(c("set"), j)["source"] != p["source"]))
    sets = sets.withColumn("children", F.transform("set", lambda p: F.when(p["dir"].isNotNull(), children(p)).otherwise(F.array().cast("array<int>"))))

    def step(scores: Column, i: Column) -> Column:
        own = F.get(scores, i)
        best = F.coalesce(F.array_max(F.transform(F.get(c("children"), i), lambda j: F.get(scores, j))), F.lit(0.0))
        base = F.least(own, best)
        return F.transform(scores, lambda s, k: F.when((k == i) & (best > 0) & (base > 0), s + base * INHERITED).otherwise(s))

    start = F.transform("set", lambda p: p["score"])
    lifted = F.when(c("intent") == "signal_empty", start).otherwise(F.aggregate(F.sequence(F.lit(0), F.size("set") - 1), start, step))
    return sets.withColumn("lifted", lifted).select(query, F.explode(F.arrays_zip(F.transform("set", lambda p: p["source"]).alias("source"), c("lifted").alias("score"))).alias("x")).select(query, "x.source", "x.score")


def reranked(candidates: DataFrame, query: str, stems=lambda tokens: tokens) -> DataFrame:
    """features with the final score and rerank_rank, by score, rank of the best chunk, source."""
    c = F.col
    scored = features(candidates, query, stems)
    final = inherited(scored, query).select(c(query).alias("__query"), c("source").alias("__source"), c("score").alias("__final"))
    out = scored.withColumnRenamed("score", "model_score").join(final, (c(query) == c("__query")) & (c("source") == c("__source"))).drop("__query", "__source").withColumnRenamed("__final", "score")
    return out.withColumn("rerank_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rounded(c("score"), 9)), "chunk_rank", "source")))
