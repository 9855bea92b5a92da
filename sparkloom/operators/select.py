"""Which sources of a query are shown, in which order: labels and promotions, then a close call between the first two, put to a vote.

Everything about a query's sources as a whole (who alone owns the title, who covers most, whether a concept supports them) is an aggregate over the query's
sources, which are few (see selection.TOP_SOURCES). No source that is labelled unsupported is ever selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scoring import rounded
from ..functions.text import tokenize
from .rerank import CLASSES, VERSION

# What a label is worth, what promotions add, the step of the incoming rank.
LABELS = {"covers": 1.0, "partial": 0.5, "adjacent": 0.35, "too_broad": 0.25, "too_narrow": 0.25}
PARENT, DECISION, ANCHORED, CHANGELOG, EXAMPLE, CONCEPT = 0.30, 0.30, 0.30, 0.60, 0.55, 0.40
EXACT, SUBSET, LANDING = 0.50, 0.65, 0.70
STEP = 1e-4
# Tokens (stems) that ask for a history of releases or for an overview, and those that say nothing in a title.
HISTORY = "^(version|break|deprecat|changelog|releas|release|chang|histori|note|fix|new|sinc)$"
MOVING = "^(migrat|upgrad|adopt|move)$"
OVERVIEW = "^(overview|intro|introduct|explain|concept|basic|orient|understand|big|pictur|tldr|primer|guid|what)$"
OVERVIEW_NOISE = (
    "what", "which", "where", "when", "who", "why", "how", "do", "doe", "does", "mean", "explain", "overview", "intro", "introduct", "concept", "basic", "orient", "understand", "big", "pictur", "primer", "guid",
)
GENERIC = (
    "advanced", "api", "basic", "concept", "config", "configur", "doc", "docs", "error", "file", "get", "getting", "guide", "index", "intro", "introduct", "main", "overview", "readm", "refer", "reference",
    "schema", "start",
)
#: The classes of equal tokens that titles are compared by: the last three.
TITLE_CLASSES = CLASSES[3:]
OVERVIEW_KINDS = ("concept", "guide", "quick_start", "readme", "package_readme")
OVERVIEW_TITLE, LANDING_TITLE = r"\b(overview|introduction|intro|concept|guide|basics|primer)\b", r"\b(introduction|intro|overview)\b"
# When a close call is put to the vote, and by how much a vote must be won; reasons that alone don't decide it.
CLOSE, WON = 0.5, 2
NEUTRAL = (
    "canonicality_parent_for_broad", "canonicality_leaf_for_exact", "family_parent_over_child", "role_compat_overview_for_broad", "role_compat_guide_for_broad", "role_compat_concept_for_broad",
)
BROAD_FIT = {"overview": 3, "guide": 2, "concept": 2, "api": 0, "reference": 0, "child_detail": 0}
BROAD_REASONS = ("overview", "guide", "concept")
HITS = ("none", "scattered", "ordered", "near", "exact")
STRUCTURAL = ("path", "title", "h1", "heading")
RELEASE_WORDS, UPGRADE_WORDS, SYMPTOMS = ("changelog", "release", "releases"), ("migration", "migrate", "upgrade"), ("error", "fix", "broken", "why")


def _equal(token: Column) -> Column:
    out = F.array(token)
    for names in TITLE_CLASSES:
        out = F.when(token.isin(*names), F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def _telling(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$") & ~t.isin(*GENERIC))


def subset_score(title: Column, query: Column) -> Column:
    """How many telling tokens a title has, if the query has them all: half a point more where one is there by its class only; 0 where one is missing or none is specific."""
    own = _telling(F.array_distinct(title))
    direct = lambda t: F.array_contains(query, t)
    by_class = lambda t: F.arrays_overlap(F.filter(_equal(t), lambda e: e != t), query)
    semantic = F.exists(own, lambda t: ~direct(t) & by_class(t))
    ok = (F.size(own) > 0) & F.forall(own, lambda t: direct(t) | by_class(t)) & F.exists(own, lambda t: F.length(t) >= 5) & ((F.size(own) > 1) | semantic)
    return F.when(ok, F.size(own) + F.when(semantic, 0.5).otherwise(0.0)).otherwise(0.0)


def covered_tokens(names: Column, query: Column) -> Column:
    """The query's tokens that a title and a file name can vouch for."""
    known = F.flatten(F.transform(_telling(names), _equal))
    return F.array_distinct(F.filter(query, lambda q: F.arrays_overlap(_equal(q), known)))


def asks_history(tokens: Column) -> Column:
    says = lambda p: F.exists(tokens, lambda t: t.rlike(p))
    return says(HISTORY) | (says(MOVING) & says(VERSION.replace("(?i)", "")))


def is_changelog(purpose: Column, source: Column) -> Column:
    low = F.lower(source)
    return F.coalesce(purpose.isin("changelog", "release_note"), F.lit(False)) | F.endswith(low, F.lit("changelog.md")) | F.endswith(low, F.lit("/release.md"))


def selection(sources: DataFrame, query: str, stems=lambda tokens: tokens) -> DataFrame:
    """The sources that aren't unsupported, with selection_score, selection_rank and promotions (an array of reasons).

    sources: query, source, rank, tokens (of the query), intent, title, purpose, label, reasons (see selection.aboutness), combined, and trusted (whether given file anchors are trusted), or none.
    """
    c, w = F.col, Window.partitionBy(query)
    has = lambda r: F.array_contains("reasons", r)
    leaf = F.lower(paths.stem(c("source")))
    title = F.lower(F.coalesce("title", F.lit("")))
    kind = F.coalesce("purpose", F.lit(""))
    broad = c("intent").isin("broad_domain", "decision_lookup")
    s = sources.withColumn("__title", stems(tokenize(F.coalesce("title", F.lit(""))))).withColumn("__file", stems(tokenize(paths.stem(c("source")))))
    key = lambda t: F.sort_array(F.array_distinct(t))
    live = c("label") != "unsupported"
    s = s.withColumns({
        "__history": live & has("changelog_release_intent") & is_changelog(c("purpose"), c("source")) & asks_history(c("tokens")),
        "__exact": (F.size("tokens") > 0) & ((key(c("__title")) == key(c("tokens"))) | (key(c("__file")) == key(c("tokens")))),
        "__subset": F.greatest(subset_score(c("__title"), c("tokens")), subset_score(c("__file"), c("tokens"))), "__covered": covered_tokens(F.concat("__title", "__file"), c("tokens")),
        "__landing": title.rlike(LANDING_TITLE) | leaf.isin("introduction", "intro", "overview") | F.contains(F.lower("source"), F.lit("/introduction/")),
    })
    s = s.withColumns({
        "__n_history": F.sum(c("__history").cast("int")).over(w), "__n_exact": F.sum(c("__exact").cast("int")).over(w), "__best": F.max("combined").over(w), "__top": F.max("__subset").over(w),
        "__supported": F.max(live & (kind == "concept")).over(w), "__all": F.size(F.array_distinct(F.flatten(F.collect_list("__covered").over(w)))),
    })
    s = s.withColumn("__tops", F.sum((c("__subset") >= c("__top") - 1e-9).cast("int")).over(w))
    owner = (c("__top") > 0) & (c("__subset") >= c("__top") - 1e-9) & (c("__tops") == 1) & (F.size("__covered") == c("__all"))
    asks = F.exists("tokens", lambda t: t.rlike(OVERVIEW))
    pure = F.size(F.filter(F.array_distinct("tokens"), lambda t: ~t.isin(*OVERVIEW_NOISE))) <= 2
    s = s.withColumn("__owner", owner).withColumn("__owned", F.max("__owner").over(w))
    free = (c("__n_exact") != 1) & (c("__n_history") == 0)
    concept_best = (c("combined") >= c("__best") - 1e-9) | asks
    trusted = c("trusted") if "trusted" in sources.columns else F.lit(True)
    # One rule at most makes an owner, the first of these; releases asked for keep all others from it.
    rules = [
        ("parent_over_leaf", broad & has("parent_vs_leaf") & (kind.isin(*OVERVIEW_KINDS) | title.rlike(OVERVIEW_TITLE) | leaf.isin("readme", "index", "_index", "overview")), PARENT),
        ("decision_over_procedural", (c("intent") == "decision_lookup") & has("decision_vs_procedural") & kind.isin("concept", "adr", "prd"), DECISION),
        ("anchored_over_broad", (c("intent") == "file_anchored") & trusted & has("guide_vs_reference") & (kind != "api_reference"), ANCHORED),
        ("changelog_release_intent_preserved", c("__history"), CHANGELOG),
        ("title_exact_match_promoted", c("__exact") & (c("__n_exact") == 1) & ((c("__n_history") == 0) | c("__history")), EXACT),
        ("title_subset_match_promoted", free & c("__owner"), SUBSET),
        ("overview_landing_promoted", free & ~c("__owned") & asks & pure & c("__landing") & (c("intent") == "broad_domain"), LANDING),
        ("example_for_broad_domain_promoted", (c("intent") == "broad_domain") & (kind == "example") & c("label").isin("partial", "covers") & c("__supported"), EXAMPLE),
        ("concept_over_leaves_by_purpose_promoted", broad & has("concept_over_leaves_by_purpose") & (kind == "concept") & concept_best, CONCEPT),
    ]
    base = F.lit(0.0)
    for name, worth in LABELS.items():
        base = F.when(c("label") == name, worth).otherwise(base)
    score = base + sum(F.when(cond, worth).otherwise(0.0) for _, cond, worth in rules) - c("rank") * STEP
    said = [F.when(c("label") == "covers", "covers_label"), *[F.when(cond, name) for name, cond, _ in rules], *[F.when(c("label") == x, f"demoted_{x}") for x in ("too_narrow", "too_broad", "adjacent")]]
    s = s.where(live).withColumn("selection_score", score).withColumn("promotions", F.array_compact(F.array(*said)))
    concept = F.max(F.when(kind == "concept", c("selection_score"))).over(w)
    capped = F.array_contains("promotions", "example_for_broad_domain_promoted") & (c("selection_score") >= concept)
    s = s.withColumn("selection_score", F.when(capped, concept - STEP).otherwise(c("selection_score")))
    s = s.withColumn("selection_rank", F.row_number().over(w.orderBy(F.desc(rounded(F.col("selection_score"), 9)), "rank")))
    return s.drop(*[x for x in s.columns if x.startswith("__")])


def anchor_strength(source: Column, anchors: Column, stems=lambda tokens: tokens) -> Column:
    """2 if an anchor is the file's bare name, 1 if a part of an anchor is one of its forms (or has its stem, of 4 characters or more), else 0."""
    bare = paths.stem(source)
    low = F.lower(bare)
    forms = F.filter(F.array_distinct(F.concat(F.array(low, F.regexp_replace(low, "[-_]", "")), F.split(low, "[-_]+"))), lambda f: (F.length(f) >= 3) & f.rlike("^[a-z][a-z0-9]*$"))

    def parts(a: Column) -> Column:
        pieces = F.filter(F.split(a, "[.\\-_/]+"), lambda p: p != "")
        humps = F.filter(F.flatten(F.transform(pieces, lambda p: F.split(F.regexp_replace(p, "([a-z0-9])(?=[A-Z])", "$1\u0001"), "\u0001"))), lambda p: F.length(p) >= 2)
        return F.filter(F.concat(F.array(F.lower(a)), F.transform(pieces, F.lower), F.transform(humps, F.lower)), lambda p: F.length(p) >= 3)

    every = F.flatten(F.transform(anchors, parts))
    alike = F.arrays_overlap(F.filter(stems(forms), lambda f: F.length(f) >= 4), stems(every))
    return F.when(F.array_contains(anchors, bare), 2).when(F.arrays_overlap(forms, every) | alike, 1).otherwise(0)


def pair_votes(a: Column, b: Column, intent: Column, stems=lambda tokens: tokens) -> Column:
    """array<struct<delta, reason>>: the votes of six judges on two sources, positive for a. a, b: structs with source, tokens, role, canonicality, family, relation, hit, field, anchors, title_coverage."""
    vote = lambda delta, reason: F.struct(delta.cast("int").alias("delta"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    word = lambda names: F.arrays_overlap(F.concat(a["tokens"], b["tokens"]), F.array(*[F.lit(n) for n in names]))
    one = lambda x, y, worth=1: F.when(x & ~y, worth).when(y & ~x, -worth)
    release, upgrade = word(RELEASE_WORDS), word(UPGRADE_WORDS)
    exact, settled = intent.isin("exact_symbol", "file_anchored"), intent.isin("broad_domain", "decision_lookup")
    rank = lambda s: F.array_position(F.array(*[F.lit(h) for h in HITS]), s["hit"]) + F.when(s["field"].isin(*STRUCTURAL), 1).otherwise(0)
    gap = rank(a) - rank(b)
    fit = lambda s: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BROAD_FIT.items() for x in kv]), s["role"]), F.lit(1))
    lead = F.when(fit(a) >= fit(b), a["role"]).otherwise(b["role"])
    role = lambda name: (a["role"] == name, b["role"] == name)
    decided, conceived = role("decision"), role("concept")
    decision = F.coalesce(one(*decided, 2), F.when(conceived[0] & ~conceived[1] & ~decided[1], 1).when(conceived[1] & ~conceived[0] & ~decided[0], -1))
    canon = lambda name: one(a["canonicality"] == name, b["canonicality"] == name)
    anchors = F.when(F.size(a["anchors"]) > 0, a["anchors"]).otherwise(b["anchors"])
    strength = anchor_strength(a["source"], anchors, stems) - anchor_strength(b["source"], anchors, stems)
    diff = a["title_coverage"] - b["title_coverage"]

    def named(s: Column) -> Column:
        bare = paths.stem(s["source"])
        return bare.rlike("^[A-Za-z][A-Za-z0-9]*$") & F.arrays_overlap(F.filter(stems(F.array(F.lower(bare))), lambda t: F.length(t) >= 2), s["tokens"])

    topical = (F.abs(diff) >= 0.3) & (F.greatest(a["title_coverage"], b["title_coverage"]) >= 0.5) & F.when(diff > 0, named(a) & ~named(b)).otherwise(named(b) & ~named(a))
    same_family = (a["family"] == b["family"]) & settled
    votes = [
        (F.when(gap != 0, F.signum(gap) * F.when(F.abs(gap) >= 2, 2).otherwise(1)), "phrase_proximity_stronger"),
        (F.when((intent == "broad_domain") & ~word(("changelog", "release", "releases", "migration", "migrate", "upgrade")) & lead.isin(*BROAD_REASONS) & (fit(a) != fit(b)), fit(a) - fit(b)), F.concat(F.lit("role_compat_"), lead, F.lit("_for_broad"))),
        (F.when(exact, one(*role("api"))), "role_compat_api_for_exact"), (F.when(intent == "decision_lookup", decision), "role_compat_decision_for_decision_lookup"),
        (F.when(word(SYMPTOMS), one(*role("troubleshooting"), 2)), "role_compat_troubleshooting_for_symptom"),
        (F.when(release, one(*role("changelog"), 2)), "role_compat_changelog_for_release_intent"), (F.when(upgrade, one(*role("migration"), 2)), "role_compat_migration_for_upgrade_intent"),
        (F.when(settled, canon("parent")), "canonicality_parent_for_broad"), (F.when(exact, canon("child")), "canonicality_leaf_for_exact"),
        (F.when(same_family, one(a["relation"] == "parent", b["relation"] == "parent")), "family_parent_over_child"),
        (F.when(strength != 0, F.signum(strength) * 3), "anchor_symbol_basename_match"), (F.when(topical, F.signum(diff) * 3), "title_token_coverage_decisive"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(delta, F.lit(0)) != 0, vote(delta, reason)) for delta, reason in votes]))


def verdict(votes: Column) -> Column:
    """Struct (winner, confidence, margin, reasons) of votes; the reasons are those of the winner's side, or all on a tie."""
    margin = F.aggregate(votes, F.lit(0), lambda n, v: n + v["delta"])
    winner = F.when(margin > 0, "a").when(margin < 0, "b").otherwise("tie")
    reasons = F.array_distinct(F.transform(F.filter(votes, lambda v: (margin == 0) | (F.signum(v["delta"]) == F.signum(margin))), lambda v: v["reason"]))
    return F.struct(winner.alias("winner"), F.when(F.abs(margin) >= 3, "high").when(F.abs(margin) >= 2, "medium").otherwise("low").alias("confidence"), margin.alias("margin"), reasons.alias("reasons"))


CARD = ("source", "tokens", "role", "canonicality", "family", "relation", "hit", "field", "anchors", "title_coverage")


def close_calls(selected: DataFrame, query: str, stems=lambda tokens: tokens) -> DataFrame:
    """(query, a, b, margin, verdict) of the first two sources of each query whose scores are closer than CLOSE, put to the vote. selected: selection with the columns CARD."""
    c = F.col
    card = F.struct("selection_score", *CARD)
    at = lambda k: F.max(F.when(c("selection_rank") == k, card))
    pairs = selected.where(c("selection_rank") <= 2).groupBy(query).agg(at(1).alias("a"), at(2).alias("b"), F.first("intent").alias("intent")).where(c("b").isNotNull())
    pairs = pairs.withColumn("margin", c("a.selection_score") - c("b.selection_score")).where(rounded(c("margin"), 9) < CLOSE)
    return pairs.withColumn("votes", pair_votes(c("a"), c("b"), c("intent"), stems)).withColumn("verdict", verdict(c("votes")))


def swapped(selected: DataFrame, query: str, stems=lambda tokens: tokens) -> DataFrame:
    """selected, where the vote on a close call puts the second source first: the two change their places and scores, and the new first one gets a reason.

    A vote moves something only if it is won by WON or more and by a reason that is more than a matter of shape.
    """
    c = F.col
    calls = close_calls(selected, query, stems)
    v = c("verdict")
    wins = (v["winner"] == "b") & v["confidence"].isin("high", "medium") & (F.abs(v["margin"]) >= WON) & F.exists(v["reasons"], lambda r: ~r.isin(*NEUTRAL))
    moved = calls.where(wins).select(c(query).alias("__q"), c("a.selection_score").alias("__high"), c("b.selection_score").alias("__low"))
    out = selected.join(moved, c(query) == c("__q"), "left")
    hit = c("__q").isNotNull() & (c("selection_rank") <= 2)
    promoted = hit & (c("selection_rank") == 2)
    return out.select(
        *[x for x in selected.columns if x not in ("selection_score", "selection_rank", "promotions")], F.when(promoted, c("__high")).when(hit, c("__low")).otherwise(c("selection_score")).alias("selection_score"),
        F.when(hit, 3 - c("selection_rank")).otherwise(c("selection_rank")).alias("selection_rank"), F.when(promoted, F.array_append("promotions", F.lit("pairwise_rerank_promoted"))).otherwise(c("promotions")).alias("promotions"),
    )
