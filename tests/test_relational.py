"""Every relational query against its SQL in another engine, on the smallest tables."""

import math

import duckdb
import pytest

from strandmill.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, other, name):
    got = registry.queries()[name](spark, DIR)
    want = other.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)
