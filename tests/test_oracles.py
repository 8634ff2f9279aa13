"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from assaymill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, data), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if not any(isinstance(v, str) or v is None for v in (*x, *y)) else all(p == q or (isinstance(p, float) and p == pytest.approx(q, abs=2e-6)) for p, q in zip(x, y))
