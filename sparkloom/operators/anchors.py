"""Anchor, scope, phrase and neighbourhood operators. Theta joins of the model become equi-joins on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a shared level of scope counts.
SCOPE_WEIGHTS = {"module": 1.0, "project": 0.6, "team": 0.3, "company": 0.3}


def path_suffixes(path: Column) -> Column:
    """array<string>: the path itself and all its suffixes of two segments or more."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_union(F.array(path), F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "/")))


def file_suffix_matches(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """(anchor, path) where either is the other or ends with it after a slash; a suffix has two segments or more."""
    long = paths.select("path", F.explode(path_suffixes(F.col("path"))).alias("s"))
    forth = anchors.join(long, F.col("anchor") == F.col("s")).select("anchor", "path")
    cut = anchors.select("anchor", F.explode(path_suffixes(F.col("anchor"))).alias("s"))
    return forth.union(cut.join(paths, F.col("path") == F.col("s")).select("anchor", "path")).distinct()


def scope_match(levels: dict[str, Column], scopes: list[dict[str, str]]) -> Column:
    """The best level that a row shares with any of the scopes; 0 if none. scopes are the few of a query."""
    out = [F.lit(0.0), F.lit(0.0)]
    for scope in scopes:
        out += [F.when(levels[k] == F.lit(v), SCOPE_WEIGHTS[k]) for k, v in scope.items() if k in levels]
    return F.greatest(*out)


def phrase_hits(index: DataFrame, tails: DataFrame, key: str, query: str) -> DataFrame:
    """(query, key) where the query's last two terms follow each other in one field. tails: (query, first, last); index: postings."""
    after = index.select(F.col(key).alias("k"), F.col("field").alias("f"), (F.col("pos") - 1).alias("p"), F.col("term").alias("t"))
    start = index.join(tails, F.col("term") == F.col("first"))
    same = (F.col(key) == F.col("k")) & (F.col("field") == F.col("f")) & (F.col("pos") == F.col("p")) & (F.col("last") == F.col("t"))
    return start.join(after, same).select(query, key).distinct()


def gap_groups(df: DataFrame, by: str, at: Column, gap: float, *ties: str) -> DataFrame:
    """df with the column run: rows of one value of by, in the order of at, start a new run after a gap over `gap`."""
    order = Window.partitionBy(by).orderBy("__at", *ties)
    out = df.withColumn("__at", at).withColumn("__new", F.coalesce((F.col("__at") - F.lag("__at").over(order) > gap).cast("int"), F.lit(0)))
    return out.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__at", "__new")


def renumber(df: DataFrame, section: str, *order) -> DataFrame:
    """df with place (from 1), siblings and landing (the first place) within its section."""
    within = Window.partitionBy(section)
    out = df.withColumn("place", F.row_number().over(within.orderBy(*order))).withColumn("siblings", F.count(F.lit(1)).over(within))
    return out.withColumn("landing", F.col("place") == 1)


def transitions(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(before, after, n): how many keys went from one state to another; absent where a snapshot lacks the key."""
    a = before.select(F.col(key).alias("a"), F.col(state).alias("sa"))
    b = after.select(F.col(key).alias("b"), F.col(state).alias("sb"))
    both = a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("sa", F.lit("absent")).alias("before"), F.coalesce("sb", F.lit("absent")).alias("after"))
    return both.where("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
