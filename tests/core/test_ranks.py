"""Ranks by ranges against row_number."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ranking, ranks


def test_against_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randrange(300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    for keys in (["k"], []):
        want = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "i")))
        got = ranks.ranked(df, keys, [F.desc("v"), F.asc("i")])
        assert sorted((r["i"], r["rank"]) for r in got.collect()) == sorted((r["i"], r["rank"]) for r in want.collect())
    assert ranks.ranked(df.limit(0), ["k"], [F.asc("v")]).collect() == []


def test_sources_begin_where_their_first_rows_are(spark):
    """Best ranks of sources against ranks of all rows, with ties, sources and tasks without a name, and sources that begin last."""
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b", "c", f"s{i % 50}"]), rng.randrange(9) / 8, i) for i in range(800)] + [(1, "z", -1.0, 801), (3, "a", 0.5, 5)]
    df = spark.createDataFrame(rows, "q int, s string, score double, k int")
    placed = df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k")))
    want = placed.groupBy("q", "s").agg(F.min("rank"), F.max("score"), F.count(F.lit(1)))
    plain = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert plain(ranking.source_candidates(df, "q", "s", "score", "k")) == plain(want)
