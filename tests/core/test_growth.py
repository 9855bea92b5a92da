"""What queries shuffle grows no faster than their tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ranks
from sparkloom.plans import catalog, context, fusion, reranking, review  # noqa: F401  (they register their queries)
from sparkloom.plans import queries as plan

SMALL, TIMES = 1000, 6


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """The same tables in two sizes; benchmark alone doesn't grow."""
    words = [a + b for a in ("ba", "ke", "li", "mo", "nu") for b in ("rta", "sde", "ffo", "gli")]
    rng = random.Random(3)
    out = []
    for n in (SMALL, SMALL * TIMES):
        folder = str(tmp_path_factory.mktemp(f"n{n}"))
        docs = [(i, " ".join(rng.choices(words, k=12)), rng.choice(["en", "de"]), f"src{i % 4}", rng.randrange(60, 400)) for i in range(n)]
        tables = {
            "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int"),
            "pages": ([(i, f"https://example.com/en/p{i}.html", "") for i in range(n)], "page_id long, url string, html string"),
            "benchmark": ([(i, " ".join(rng.choices(words, k=6))) for i in range(6)], "item_id long, text string"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(4).write.parquet(f"{folder}/{name}.parquet")
        out.append(folder)
    return out


def _shuffled(spark, name, folder):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    plan.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.parametrize("name", ["link_suggestions"])
def test_shuffles_in_proportion(spark, grown, name):
    small, large = (_shuffled(spark, name, folder) for folder in grown)
    assert large < 1.6 * TIMES * small


def test_segments_meet_each_symbol_once(spark, grown):
    """Cards are counted before they meet the pages: what the join gives out doesn't grow with the cards of a symbol."""
    out = plan.QUERIES["segment_fallback"](spark, grown[1])
    plans = out._jdf.queryExecution().optimizedPlan().toString()
    join = plans.index("Join Inner, (segment")
    assert "Aggregate [symbol" in plans[join:]
    assert out.count() <= 2 * SMALL * TIMES


@pytest.mark.parametrize("name", ["adjacent_margins", "coverage_confidence", "eval_mrr"])
def test_first_ranks_need_no_ranks_of_all(spark, sf, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("all scored documents are ranked")

    monkeypatch.setattr(ranks, "ranked", none)
    assert plan.QUERIES[name](spark, sf).count() > 0


def test_only_the_first_sources_are_profiled(spark, sf):
    assert {r["doc_id"] for r in reranking.profiled(spark, sf, spark.range(3, 5).select(F.col("id").alias("doc_id"))).collect()} == {3, 4}


@pytest.mark.parametrize("name", ["rrf_fusion", "source_aggregate"])
def test_sources_are_found_without_ranks_of_all(spark, grown, monkeypatch, name):
    """Only the rows up to the best one of each task's last source are ranked."""
    seen, plain = [], ranks.ranked
    monkeypatch.setattr(ranks, "ranked", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    assert plan.QUERIES[name](spark, grown[1]).count() == 6 * 4
    assert sum(seen) < SMALL * TIMES / 4
