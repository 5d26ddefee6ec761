"""Every query with SQL gives the rows of that SQL."""

import glob

import duckdb
import pytest

from lectern import catalog

from .conftest import SF


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(out.columns)
    assert canon(out.collect(), out.columns) == canon(cur.fetchall(), names)
