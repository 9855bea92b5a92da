"""Candidates that are ranked where their documents are, against joins and windows over the same tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fusion as operator
from sparkloom.plans import fusion
from sparkloom.plans import queries as plan
from sparkloom.sources.scratch import written


def _tables(spark, folder, n, n_tasks, seed=5):
    """Texts of few words, so that many documents have the same scores; copies; texts that are empty or null."""
    words = [a + b for a in ("ba", "ke", "li", "mo") for b in ("rta", "sde", "ffo")]
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 16))) for _ in range(60)] + ["", None]
    docs = [(5 * i + 1, rng.choice(texts), f"src{i % 4}") for i in range(n)]
    tasks = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(n_tasks)] + [(50, ""), (51, None), (72, "sffo keffo"), (80, "unheard of"), (81, "src2 limo")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(tasks, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return [_tables(spark, str(tmp_path_factory.mktemp(f"fusion{n}")), n, k) for n, k in ((700, 8), (4200, 60))]


def _plain(df):
    return sorted(map(tuple, df.collect()))


def test_in_blocks_and_bands_as_by_windows(spark, tables, monkeypatch):
    """Blocks of 64 sources and narrow bands, so that groups are cut and ties go over blocks."""
    monkeypatch.setattr(operator, "CELLS", 1)
    monkeypatch.setattr(operator, "WIDE", 12)
    monkeypatch.setattr(operator, "NARROW", 17)
    known = written(fusion.profiles(spark, tables[0]), "profiles")
    found = fusion.in_place(spark, tables[0], known)
    want = written(fusion.candidates(spark, tables[0], known), "want")
    order = ["item_id", "source", "path", "rank", "score"]
    got = _plain(found.candidates().select(order))
    assert {r[2] for r in got} == set(operator.PATHS) and len({r[4] for r in got if r[2] == "anchor"}) == 2
    assert [r[:4] for r in got] == [r[:4] for r in _plain(want.select(order))]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in _plain(want.select(order))])
    order = ["item_id", "source", "n_paths", "rank", "fused"]
    got, want = _plain(found.fused().select(order)), _plain(operator.fused(want, "item_id").select(order))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-9)
    assert found.places.select("g", "band").distinct().groupBy("g").count().agg(F.max("count")).first()[0] > 1


@pytest.mark.parametrize(("name", "most"), [("candidate_paths", 20), ("fused_sources", 70)])
def test_a_pair_shuffles_few_bytes(spark, tables, name, most):
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    n = plan.QUERIES[name](spark, tables[1]).count()
    assert shuffled() - before < most * n


@pytest.mark.parametrize("name", ["candidate_paths", "fused_sources"])
def test_sources_without_a_name(spark, tmp_path, name):
    """What can't be ranked in place goes by windows: nothing is lost."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "barta keffo", None), (2, "barta limo", "a"), (3, None, "b")], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "limo barta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = plan.QUERIES[name](spark, folder).collect()
    assert {r["source"] for r in found} >= {None, "a/v2/barta-2.md"}
