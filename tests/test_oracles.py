"""Every query with SQL against DuckDB on the same tables, and the others for running at all."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from mosaicell.plans import catalog

from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(round(float(r[k]), 6) + 0.0 if isinstance(r[k], float) or type(r[k]).__name__ == "Decimal" else r[k] for k in order) for r in rows]
    return sorted(out, key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = plain(rel.fetchall(), names)
    assert sorted(df.columns) == sorted(names) and len(got) == len(want) and got
    kinds = {type(g) for g, w in zip(got[0], want[0]) if type(g) is not type(w) and g is not None and w is not None}
    assert not kinds, (got[0], want[0])
    assert all(all(map(close, g, w)) for g, w in zip(got, want)), next((g, w) for g, w in zip(got, want) if not all(map(close, g, w)))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
