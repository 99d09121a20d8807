import duckdb
import pytest

import __spark_entry__
from flowgauge.plans import queries
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, db, name):
    assert same_rows(queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).fetchdf())


def test_entry(spark):
    got = {r["symbol"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert got == {"BNBUSDT": 30, "BTCUSDT": 9, "DOGEUSDT": 29, "ETHUSDT": 8}


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
