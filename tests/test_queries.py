import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadglass.plans.oracles import SQL
from roadglass.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_registered():
    assert set(SQL) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got == sorted(map(repr, duck.sql(f"select {columns} from ({SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", ["csv_scan", "profile_report", "profile_totals"])
def test_small_balances_as_sql(spark, tmp_path, name):
    """Balances of a few cents, whose fiftieth Spark's cast prints as 2.0E-4."""
    balance = "CASE WHEN c_custkey % 3 = 0 THEN round((c_custkey % 11 - 5) / 100, 2) ELSE c_acctbal END"
    spark.read.parquet(f"{SF}/customer.parquet").withColumn("c_acctbal", F.expr(balance).cast("double")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, con.sql(f"select {columns} from ({SQL[name]})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
