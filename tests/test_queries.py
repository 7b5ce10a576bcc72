"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat()[:26] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def names():
    import __spark_entry__

    return sorted(__spark_entry__.registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    done = db.execute(sql)
    at = [d[0] for d in done.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in done.fetchall())
