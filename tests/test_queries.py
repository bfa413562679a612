"""Each query against its SQL on the small tables, as far as they are there."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from voltlake import queries

DIR = Path("/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list:
    """Values as text; a column of whole numbers with nulls comes as doubles from one side."""
    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    show = lambda v: "" if pd.isna(v) else repr(round(float(v), 5) + 0.0) if number(v) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DIR)).toPandas()
    assert rows(got) == rows(duck.sql(queries.ORACLE_SQL[name]).df())
