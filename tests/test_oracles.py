"""Each query of the library beside its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from fathomline.plans import registry
from fathomline.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.8g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    made = registry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    told = duck.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    rows = sorted(tuple(map(plain, r)) for r in made.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in told.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
