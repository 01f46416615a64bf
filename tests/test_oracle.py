"""Every query with SQL gives the rows of that SQL."""

import math

import duckdb
import pytest

from brackenlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
