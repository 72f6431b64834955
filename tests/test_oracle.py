"""Every registered query with a SQL twin, against DuckDB on the given tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from statloom.plans import registry  # noqa: E402

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 4) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace("T00:00:00", "")
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-4 * max(1, abs(a))) or (isinstance(b, float) and isinstance(a, int) and abs(a - b) < 1e-6)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b) and len(a) > 0
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(close(p, q) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
