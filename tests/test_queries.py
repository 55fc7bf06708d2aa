"""Every registered query of the library against its SQL twin in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from landquill import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return format(float(v), ".9g") if isinstance(v, float) or hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events", "supplier"):
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    assert len(names) == len(columns)
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
