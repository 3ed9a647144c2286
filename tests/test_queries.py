"""Every query with SQL gives the rows that DuckDB gives; the others give rows at all."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rasterloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    keys = [c for c in columns if not pd.api.types.is_float_dtype(df[c])] or columns
    return df[columns].sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = ordered(catalog.QUERIES[name](spark, DATA).toPandas())
    assert len(got)
    if name not in catalog.ORACLE_SQL:
        return
    want = ordered(db.execute(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        for a, b in zip(got[c], want[c], strict=True):
            if isinstance(a, float):
                assert (math.isnan(a) and (b is None or b is pd.NA or math.isnan(b))) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6), (c, a, b)
            else:
                assert a == b or (pd.isna(a) and pd.isna(b)), (c, a, b)
