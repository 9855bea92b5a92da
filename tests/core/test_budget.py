"""The budget fill against a loop over each query's rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import budget
from sparkloom.plans import queries as plan
from sparkloom.sources.scratch import written


def _filled(rows):
    """(query, rank, used, included) of rows (query, rank, tokens, budget), one by one."""
    out, used = [], {}
    for q, rank, tokens, most in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        fits = tokens is not None and used.get(q, 0) + tokens <= most
        used[q] = used.get(q, 0) + (tokens if fits else 0)
        out.append((q, rank, used[q], fits))
    return out


@pytest.mark.parametrize("held", [budget.HELD if hasattr(budget, "HELD") else 0, 40])
def test_against_a_loop(spark, monkeypatch, held):
    monkeypatch.setattr(budget, "HELD", held, raising=False)
    monkeypatch.setattr(budget, "HEAD", 3 if held == 40 else 1000, raising=False)
    rng = random.Random(5)
    most = {None: 50, "a": 300, "b": 0, "c": 7, "d": 4000, "e": 20}
    sizes = {None: [1, 2, 60, 0], "a": range(400), "b": [0, 1, 5], "c": [8, 9], "d": [1, 3000, 2500, None, 0, 900], "e": [3]}
    rows = [(q, i + 1, rng.choice(list(sizes[q])), m) for q, m in most.items() for i in range(1500)]
    rng.shuffle(rows)
    ranked = written(spark.createDataFrame(rows, "q string, rank int, tokens int, most int").repartition(5), "t")
    plain = lambda df: sorted(((r["q"], r["rank"], r["used"], r["included"]) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))
    assert plain(budget.greedy_fill(ranked, "q", "rank", "tokens", "most")) == _filled(rows)
    assert plain(budget.greedy_fill(ranked, "q", "rank", "tokens", 100)) == _filled([(q, r, t, 100) for q, r, t, _ in rows])
    monkeypatch.setattr(budget, "BROADCAST_STEPS", 0, raising=False)
    assert plain(budget.greedy_fill(ranked, "q", "rank", "tokens", "most")) == _filled(rows)
    assert budget.greedy_fill(ranked.limit(0), "q", "rank", "tokens", 100).collect() == []


def test_a_query_of_any_length_stays_where_it_is(spark):
    """One query's rows go neither through a shuffle nor into one task."""
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    ranked = written(spark.range(1, 300_001, numPartitions=4).select(F.lit(1).alias("q"), F.col("id").alias("rank"), (F.col("id") * 7919 % 1000 + 1).alias("tokens")), "t")
    before = sent()
    parts = budget.greedy_fill(ranked, "q", "rank", "tokens", 200).select(F.spark_partition_id().alias("p"), "included").groupBy("p").agg(F.count("*").alias("n"), F.count_if("included").alias("k")).collect()
    assert sent() - before < 200_000
    assert sum(r["n"] for r in parts) == 300_000 and len(parts) > 1 and sum(r["k"] for r in parts) > 1


def test_packs_of_documents_without_text(spark, tmp_path):
    """A document without text is found by its title; it has no size, and is omitted."""
    docs = [(1, "alpha", None), (2, "alpha", "alpha beta"), (3, "beta", "alpha " * 3000), (4, "gamma", "x")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["tokens"], r["disposition"]) for r in plan.QUERIES["pack_greedy_budget"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, "omitted"), 2: (3, "included"), 3: (4500, "omitted")}
