"""Sources of a query judged against each other: what each is about, families, ambiguity.

The sources of a query are its TOP_SOURCES first ones, so they travel as one array in one shuffle, and are compared within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many sources are judged, the margin of a close call, names of purposes.
TOP_SOURCES = 50
CLOSE_CALL = 0.05
DECISIONS = ("concept", "adr", "prd")
PROCEDURES = ("guide", "api_reference", "runbook")
OVERVIEWS = ("concept", "guide", "readme")
LEAVES = ("guide", "api_reference")


def source_sets(sources: DataFrame, query: list[str], columns: list[str]) -> DataFrame:
    """(query columns, set): the first sources of each query, by rank and path, as an array of structs."""
    place = F.row_number().over(Window.partitionBy(*query).orderBy("rank", "path"))
    top = sources.withColumn("__place", place).where(F.col("__place") <= TOP_SOURCES)
    return top.groupBy(*query).agg(F.sort_array(F.collect_list(F.struct("rank", "path", *columns))).alias("set"))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def _above(a: Column, b: Column) -> Column:
    """Whether page a is the landing page of a directory that b is in."""
    return (a != b) & F.startswith(b, F.concat(_bare(a), F.lit("/")))


def _depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def changelog_path(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith("changelog.md") | F.contains(low, F.lit("/release-notes")) | low.endswith("/release.md")


def relationship_reasons(t: Column, others: Column) -> Column:
    """array<string>: how a source stands to the other sources of its query."""
    p = t["purpose"]
    any_purpose = lambda names: F.exists(others, lambda o: o["purpose"].isin(*names))
    parent = F.exists(others, lambda o: _above(t["path"], o["path"]))
    container = (F.size(others) > 0) & F.forall(others, lambda o: _depth(o["path"]) > _depth(t["path"]))
    when = lambda c, name: F.when(c, name)
    return F.array_compact(F.array(
        when(p.isin("changelog", "release_note") | changelog_path(t["path"]), "changelog_release_intent"),
        when(parent, "parent_vs_leaf"), when(parent & p.isin(*OVERVIEWS), "overview_vs_leaf"),
        when(container & ~parent, "broad_container_vs_specific_topic"),
        when((p.isin(*DECISIONS) & any_purpose(PROCEDURES)) | (p.isin(*PROCEDURES) & any_purpose(DECISIONS)), "decision_vs_procedural"),
        when(((p == "guide") & any_purpose(["api_reference"])) | ((p == "api_reference") & any_purpose(["guide"])), "guide_vs_reference"),
        when((p == "concept") & (F.size(F.filter(others, lambda o: o["purpose"].isin(*LEAVES))) >= 2), "concept_over_leaves_by_purpose"),
    ))


def about_label(t: Column, others: Column, intent: Column, starting: Column) -> Column:
    """covers, partial, adjacent, too_broad, too_narrow or unsupported; the first rule that holds."""
    combined, fused, best, verdict = t["combined"], t["fused"], t["best"], t["verdict"]
    narrow = F.exists(others, lambda o: _above(o["path"], t["path"])) & intent.isin("decision_lookup", "broad_domain")
    broad = F.exists(others, lambda o: _above(t["path"], o["path"])) & intent.isin("exact_symbol", "file_anchored")
    sibling = F.exists(others, lambda o: (_dir(o["path"]) == _dir(t["path"])) & (o["rank"] < t["rank"]) & (combined < 0.35) & (o["combined"] >= combined))
    first_steps = (intent == "broad_domain") & (t["purpose"] == "quick_start") & starting & (combined >= 0.2) & (fused >= 1) & (best >= 0.25)
    return (
        F.when(verdict.isin("unsupported", "needs_anchors") | ((combined < 0.05) & (fused <= 1) & (best < 0.2)), "unsupported")
        .when(narrow, "too_narrow").when(broad, "too_broad").when(sibling, "adjacent").when(verdict == "partial", "partial")
        .when(first_steps | ((combined >= 0.5) & (fused >= 1) & (best >= 0.3)), "covers").otherwise("partial")
    )


def aboutness(sources: DataFrame, query: str) -> DataFrame:
    """(query, path, rank, combined, label, reasons). sources: query, intent, starting, rank, path, purpose, combined, fused, best, verdict.

    Sources with null purposes or verdicts match no rule on these; a query without sources has no row.
    """
    sets = source_sets(sources.fillna("", ["purpose", "verdict"]), [query, "intent", "starting"], ["purpose", "combined", "fused", "best", "verdict"])

    def judge(t: Column) -> Column:
        others = F.filter("set", lambda o: o["path"] != t["path"])
        return F.struct(t["path"].alias("path"), t["rank"].alias("rank"), t["combined"].alias("combined"), about_label(t, others, F.col("intent"), F.col("starting")).alias("label"), relationship_reasons(t, others).alias("reasons"))

    return sets.select(query, F.explode(F.transform("set", judge)).alias("t")).select(query, "t.*")


def link_evidence(a: Column, b: Column) -> Column:
    """array<string>: what links two sources of a query into one family, empty if nothing does. a, b: structs with low, dir, stem, aliases."""
    root = lambda s: F.concat(F.when(s["dir"] == "", "").otherwise(F.concat(s["dir"], F.lit("/"))), s["stem"])
    inside = lambda s, o: (o["dir"] == root(s)) | F.startswith(o["dir"], F.concat(root(s), F.lit("/")))
    parts = lambda s: F.when(s["dir"] == "", 0).otherwise(F.size(F.split(s["dir"], "/")))
    base = (F.length(a["stem"]) >= 4) & (a["stem"] == b["stem"])
    alias = F.get(F.array_intersect(b["aliases"], a["aliases"]), 0)
    cousins = (parts(a) >= 2) & (parts(b) >= 2) & (_dir(a["dir"]) == _dir(b["dir"])) & (a["dir"] != b["dir"])
    return F.array_compact(F.array(
        F.when(inside(a, b), "sibling_index_parent_of_dir"), F.when(inside(b, a), "sibling_index_parent_of_dir"),
        F.when((parts(a) >= 2) & (a["dir"] == b["dir"]), "same_parent_dir"),
        F.when(cousins & ((parts(a) >= 3) | base | alias.isNotNull()), "same_grandparent_dir"),
        F.when(base, F.concat(F.lit("shared_basename:"), a["stem"])), F.when(alias.isNotNull(), F.concat(F.lit("shared_alias:"), alias)),
    ))


def families(sources: DataFrame, query: str) -> DataFrame:
    """(query, path, rank, family, family_root, evidence) of sources (query, rank, path, aliases): links between a query's sources, closed transitively.

    Families are numbered in the order of their first members. The root is an index page, else a page named as its directory, else the
    page nearest to the top. Labels spread over the links of one array, at most TOP_SOURCES times.
    """
    low = F.lower("path")
    keyed = sources.select(query, "rank", "path", F.struct(low.alias("low"), _dir(low).alias("dir"), _bare(F.substring_index(low, "/", -1)).alias("stem"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).alias("k"))
    sets = source_sets(keyed, [query], ["k"])
    other = lambda i: F.transform("set", lambda b, j: F.when(i == j, F.array().cast("array<string>")).when(i < j, link_evidence(F.get("set", i)["k"], b["k"])).otherwise(link_evidence(b["k"], F.get("set", i)["k"])))
    linked = sets.withColumn("links", F.transform("set", lambda a, i: other(i)))
    near = F.transform("links", lambda row: F.filter(F.transform(row, lambda e, j: F.when(F.size(e) > 0, j).otherwise(-1)), lambda j: j >= 0))
    spread = lambda labels: F.transform(labels, lambda own, i: F.least(own, F.coalesce(F.array_min(F.transform(F.get("near", i), lambda j: F.get(labels, j))), own)))
    labelled = linked.withColumn("near", near).withColumn("labels", F.aggregate(F.sequence(F.lit(1), F.size("set")), F.transform("set", lambda a, i: i), lambda labels, _: spread(labels)))
    # An aggregate's columns can't be read by position within the lambda that orders roots, so members are rows from here.
    rows = labelled.select(query, "labels", F.posexplode(F.arrays_zip("set", "links", F.col("labels").alias("label"))).alias("at", "m"))
    stem, parent = F.col("m.set.k.stem"), F.substring_index(F.col("m.set.k.dir"), "/", -1)
    order = F.struct(F.when(stem.isin("index", "readme"), 0).when((parent != "") & (stem == parent), 1).otherwise(2), F.size(F.split("m.set.path", "/")), "at")
    of = Window.partitionBy(query, "m.label")
    number = F.size(F.array_distinct(F.filter("labels", lambda x: x < F.col("m.label"))))
    return rows.select(
        query, F.col("m.set.path").alias("path"), F.col("m.set.rank").alias("rank"), F.concat(F.lit("family_"), number.cast("string")).alias("family"),
        F.min_by(F.col("m.set.path"), order).over(of).alias("family_root"), F.array_distinct(F.flatten("m.links")).alias("evidence"),
    )


def top_family(members: DataFrame, query: str, score: str, margin: float = CLOSE_CALL) -> DataFrame:
    """(query, ambiguous, paths): the family of a query's first two sources where both are of one family and their scores close; else its first source."""
    sets = members.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", "path", "family", F.col(score).alias("score")))).alias("s"))
    one, two = F.get("s", 0), F.get("s", 1)
    close = two.isNotNull() & (one["family"] == two["family"]) & (F.round(one["score"] - two["score"], 9) <= margin)
    same = F.transform(F.filter("s", lambda m: m["family"] == one["family"]), lambda m: m["path"])
    return sets.select(query, F.coalesce(close, F.lit(False)).alias("ambiguous"), F.when(close, same).otherwise(F.array(one["path"])).alias("paths"))


def diversified(rows: DataFrame, query: str, group: str, rank: str, keep_first: bool = False) -> DataFrame:
    """rows with place: the first row of each group before the repeats, both in order of rank. keep_first is the variant that leaves a list of two or fewer as it is."""
    nth = F.row_number().over(Window.partitionBy(query, group).orderBy(rank))
    key = [F.when(F.col("__nth") == 1, 0).otherwise(1), F.col(rank)]
    if keep_first:
        key = [F.when(F.count(F.lit(1)).over(Window.partitionBy(query)) <= 2, 0).otherwise(key[0]), F.col(rank)]
        numbered = rows.withColumn("__nth", nth).withColumn("__late", key[0])
        return numbered.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("__late", rank))).drop("__nth", "__late")
    return rows.withColumn("__nth", nth).withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*key))).drop("__nth")
