"""Tables with the values that larger scenes hold: empty channels, signed zeros, heights that are whole tiles."""

import math

import duckdb
import pytest

from rasterloom.operators import insar
from rasterloom.plans import catalog

from .test_queries import ordered


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events whose complex samples are often 0."""
    folder = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"""COPY (SELECT i AS event_id, timestamp '2024-01-01' AS ts, (i * 7 % 4 * 8 + i * 5 % 3 * 14)::BIGINT AS user_id, 'view' AS event_type,
      [60.0, 0.0, 100.0, 61.5][i // 3 % 4 + 1] AS value, '{{"k": ' || [50, 0, 70][i // 5 % 3 + 1] || '}}' AS props FROM range(6400) t(i)) TO '{folder}/events.parquet'""")
    return str(folder)


def same(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    got, want = ordered(catalog.QUERIES[name](spark, folder).toPandas()), ordered(c.execute(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for k in got.columns:
        a, b = got[k].to_numpy(float), want[k].to_numpy(float)
        assert all(x == y or (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), k


@pytest.mark.parametrize("name", ["channel_parameters", "stokes", "van_zyl", "huynen", "compact_m_chi", "compact_m_delta", "compact_m_alpha", "compact_mf3cc"])
def test_empty_channels_give_what_sql_gives(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["double_difference", "interferogram"])
def test_signed_zeros_turn_phases_as_in_sql(spark, odd, name):
    same(spark, odd, name)


def test_phases_are_linked_where_the_height_is_whole_tiles(spark):
    z = spark.sql("SELECT id div 4 div 10 AS y, id div 4 % 10 AS x, CAST(id % 4 AS INT) AS epoch, cos(0.4 * (id % 4)) AS i, sin(0.4 * (id % 4)) AS q FROM range(32 * 40)")
    out = insar.phase_linking(z, 4).collect()
    assert len(out) == 320 and all(abs(r["phase"][3] - 1.2) < 1e-9 for r in out)
