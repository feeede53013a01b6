"""Every query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from chronolex.plans import registry

SF = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = registry.queries()[name](spark, str(SF))
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(([plain(r[columns.index(c)]) for c in names] for r in found.fetchall()), key=str)
    assert [list(map(str, x)) for x in got] == [list(map(str, x)) for x in want]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows_without_sql(spark, name):
    """What rows they are: test_plain, test_words, test_language, test_table_functions, test_batches, test_layout."""
    df = registry.queries()[name](spark, str(SF))
    rows = df.collect()
    assert rows
    assert all(any(r[c] is not None for r in rows) for c in df.columns)
