"""Every registered query against its oracle SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from queryproof.plans.registry import load_all
from tests.check import compare, duck
from tests.conftest import SMALL

OWN = load_all()
SQL = {n: s for n, s in entry.oracle_sql().items() if n in OWN}
QUERIES = {n: q for n, q in entry.queries().items() if n in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    row = entry.entry(spark).collect()[0]
    assert (row["status"], row["confidence"], row["fp_match"]) == ("PASS", "HIGH", True)


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


ZERO_PAIRS = ["eq_batch", "eq_batch_shared", "jn_exists_self_pair", "jn_exists_to_in_pair", "pf_alias_cleanup_pair", "pf_boolean_tautology_pair", "sl_order_constant_pair"]


@pytest.mark.parametrize("name", ZERO_PAIRS)
def test_zero_below_zero_is_zero(name, spark, tmp_path):
    for table in ("orders", "lineitem", "nation", "supplier", "part", "region"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{SMALL}/{table}.parquet")
    customer = spark.read.parquet(f"{SMALL}/customer.parquet")
    balance = "CASE WHEN c_custkey % 3 = 0 THEN -0.0D ELSE c_acctbal END"
    customer.selectExpr("c_custkey", "c_name", "c_nationkey", f"{balance} AS c_acctbal", "c_mktsegment").write.parquet(f"{tmp_path}/customer")
    con = duck(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer/*.parquet'")
    (tmp_path / "customer.parquet").symlink_to(tmp_path / "customer")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == ""
