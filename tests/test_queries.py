"""Every registered query against its SQL over the small tables."""

import decimal
import math

import duckdb
import pytest

from metrilith.plans import registry

import __spark_entry__  # noqa: F401  registers the queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows):
    def cell(x):
        if isinstance(x, decimal.Decimal):
            x = float(x)
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
        return x

    return sorted(([cell(x) for x in r] for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, small, sql, name):
    df = registry.queries()[name](spark, small)
    con = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    want = con.fetchall()
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert len(want) > 0
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
