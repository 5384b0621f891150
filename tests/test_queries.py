"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from vaultframe.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(str(round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, duck, name):
    got = Q.QUERIES[name](spark, sf)
    if name in Q.ORACLE_SQL:
        want = duck.execute(Q.ORACLE_SQL[name])
        assert plain(got.columns, got.collect()) == plain([c[0] for c in want.description], want.fetchall())
    else:
        assert got.count() > 0
