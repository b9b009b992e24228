"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from weftwork import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float) and not math.isnan(x):
        return f"{x:.9g}"
    return str(x) if x is not None else ""


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_matches_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert mine == theirs and mine
