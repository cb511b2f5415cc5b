"""Every query with an SQL twin gives DuckDB's rows, over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corpus_engine.oracles import ORACLES
from corpus_engine.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    form = lambda x: "NULL" if pd.isna(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return list(df.columns), sorted(tuple(form(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
