"""Every query of the engine against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from turnstone.plans import registry

DATA = os.environ.get("TURNSTONE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(one(x) for x in v)
        return None if v is pd.NA or v is pd.NaT else v

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
