"""Every query of the engine that has SQL against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from quillon import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        made.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = db.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == want


def test_names():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
