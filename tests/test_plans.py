"""Physical plans, with broadcasting switched off so that nothing hides behind small tables."""

import re

import pytest

import __spark_entry__ as entry
from queryproof.plans.registry import load_all
from tests.conftest import SMALL

# Queries that write and read back while they are built have little left to plan.
QUERIES = {n: entry.queries()[n] for n in load_all()}
EAGER = {n for n in QUERIES if n.startswith(("st_", "io_"))} | {"rp_reference_closure", "eq_diff_rows", "eq_diff_sketch", "eq_sketch_report", "rp_reach_counts"}
# Numbering needs a window over the bucket counts of a key; everything else is pruned or aggregated.
RANK_ALL = {"wn_row_number", "sl_order_sensitive_compare", "sl_order_fingerprint"}


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {
            name: fn(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            for name, fn in QUERIES.items()
            if name not in EAGER
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_pairwise_joins_and_no_python(plans):
    bad = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")
    assert {n: [b for b in bad if b in p] for n, p in plans.items() if any(b in p for b in bad)} == {}


def test_windows_are_pruned_before_the_shuffle(plans):
    for name, plan in plans.items():
        windows = len(re.findall(r"(?<!Group)[ -]Window \[", plan))
        pruned = len(re.findall(r"WindowGroupLimit .*Partial", plan))
        if name not in RANK_ALL:
            assert windows == pruned, name


def test_filters_and_columns_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plans["jn_exists_semi"]
    read = re.search(r"ReadSchema: struct<([^>]*)>", plans["ag_group_count_sum"]).group(1)
    assert read == "o_orderstatus:string,o_totalprice:double"
    for name in ("cd_funnel", "rp_proposal_rows"):
        assert "l_shipdate" not in plans[name].split("ReadSchema")[1]


def test_fingerprints_shuffle_partials_only(plans):
    plan = plans["eq_exact_fingerprint"]
    assert plan.count("Exchange") == 1
    assert "partial_sum" in plan.split("Exchange")[1]
