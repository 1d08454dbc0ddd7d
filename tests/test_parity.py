"""Every query of the registry runs; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from skeinflow.plans import oracles, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    number = (int, float, np.number)
    return sorted(tuple("~" if pd.isna(v) else f"{v:.5f}" if isinstance(v, number) and not isinstance(v, bool) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in oracles.SQL:
        assert got.limit(5).count() > 0
        return
    want = db.sql(oracles.SQL[name]).df()
    have = got.toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    assert len(have) == len(want)
    assert rows(have) == rows(want)
