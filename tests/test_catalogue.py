"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quarry.plans import catalogue
from quarry.plans import knowledge, processing, records, state, structure, webpages  # noqa: F401
from quarry.sources.tables import NAMES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DIR}/{n}.parquet'")
    return c


def plain(rows):
    as_float = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
    return sorted(repr(tuple(map(as_float, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    r = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    assert plain(df.select(*(f"`{c}`" for c in cols)).collect()) == plain(r.select(",".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
