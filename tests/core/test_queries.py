"""Every core query against its SQL, value by value."""

import os

import duckdb
import pandas as pd
import pytest

from sparkloom.plans import catalog, chunking, context, fusion, ledger, review, scores, selection  # noqa: F401  (they register their queries)
from sparkloom.plans import queries as plan


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(None if pd.isna(x) else float(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(plan.ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = plan.QUERIES[name](spark, sf)
    want = duck.sql(plan.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = _plain(got.toPandas()), _plain(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) and not any(isinstance(x, str) for x in a) else a == b
