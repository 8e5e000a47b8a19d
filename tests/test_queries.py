"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pageloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df):
    def cell(v):
        if v is None or not isinstance(v, (list, dict)) and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else int(v) if not isinstance(v, (str, bool)) and hasattr(v, "__int__") else v

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in plans.ORACLE_SQL:
        wanted = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert normal(got) == normal(wanted)
