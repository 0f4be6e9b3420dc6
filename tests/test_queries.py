"""Every query against its SQL on the smallest tables; the entry module's contract."""

import os

import pytest

import __spark_entry__
from skeinwork.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return int(v) if hasattr(v, "quantize") else v


def rows(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = rows(tuple(same(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert mine == rows(tuple(same(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_a_scalar_aggregate_reads_the_whole_table(spark):
    (r,) = queries.QUERIES["op_scalar_aggregate"](spark, SF).collect()
    assert r["n"] == spark.read.parquet(f"{SF}/events.parquet").count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
