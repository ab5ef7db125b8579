"""Every registered query with a SQL twin agrees with DuckDB (rows, columns, values)."""

import datetime as dt
import math

import duckdb
import pytest

from flowlens.functions.exprs import round_doubles
from flowlens.plans import registry
from flowlens.sources.tables import TABLES, table_path

from paths import SF_SMALL

registry.load_all()
TWINNED = sorted(registry.ORACLE)
ROUNDED = registry.rounded_oracle()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", TWINNED)
def test_query_matches_sql_twin(spark, con, name):
    sdf = round_doubles(registry.QUERIES[name](spark, SF_SMALL))  # as the driver entry compares
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ROUNDED[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)


def test_every_query_has_a_callable_and_twins_are_registered_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 100
