"""Comparisons over shared scans against one comparison each."""

import pytest

from queryproof.operators import equivalence as eq
from queryproof.operators.shared import Side, compare_on_shared_scans


def side(table, *columns, where="true"):
    return [Side(table, columns, where)]


PAIRS = [
    ("same", side("a", "k", "s"), side("a", "k", "s")),
    ("fewer", side("a", "k", "s"), side("a", "k", "s", where="k > 2")),
    ("null test", side("a", "k", where="s = 'x'"), side("a", "k", where="NOT s <> 'x'")),
    ("widths", side("a", "k", "v"), side("b", "CAST(k AS INT)", "v")),
    ("two tables", side("a", "s"), side("b", "s")),
    ("union", side("a", "k", where="k <= 2") + side("a", "k", where="k > 2"), side("a", "k", where="k IS NOT NULL")),
    ("twice", side("a", "k") + side("a", "k"), side("a", "k")),
    ("empty", side("a", "k", where="false"), side("b", "k", where="k < 0")),
    ("one column twice", side("a", "k", "k"), side("a", "k", "k + 0")),
]


@pytest.fixture
def tables(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.0), (3, "y", 3.0), (3, "y", 3.0), (None, "z", None)], "k bigint, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.0), (3, "y", 3.0), (3, "y", 3.0), (None, "q", None)], "k bigint, s string, v double")
    return {"a": a, "b": b.selectExpr("k", "s", "CAST(v AS DECIMAL(10, 2)) AS v")}


@pytest.mark.parametrize("algorithm", ["native", "md5"])
def test_reports_agree_with_single_comparisons(tables, algorithm):
    def rows(sides):
        parts = [tables[s.table].filter(s.where).selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(s.columns))) for s in sides]
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    got = {r.pair_id: tuple(r) for r in compare_on_shared_scans(tables, PAIRS, algorithm).collect()}
    want = {r.pair_id: tuple(r) for r in eq.compare_batch([(n, rows(b), rows(a)) for n, b, a in PAIRS], algorithm).collect()}
    assert got == want
    assert [got[n][5] for n in ("same", "fewer", "widths", "two tables", "union", "twice")] == ["MATCH", "MISMATCH", "MATCH", "MISMATCH", "MATCH", "MISMATCH"]


def test_a_table_is_scanned_once(t):
    pairs = [(f"p{i}", side("orders", "o_orderkey", "o_orderstatus", where=f"o_custkey > {i}"), side("customer", "c_custkey", "c_name")) for i in range(20)]
    df = compare_on_shared_scans({"orders": t.orders, "customer": t.customer}, pairs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange") == 1


def test_what_can_not_be_compared(tables):
    for before, after in ((side("a", "k"), side("a", "s")), (side("a", "k"), side("a", "k", "k")), (side("a", "k") + side("a", "s"), side("a", "k"))):
        with pytest.raises(ValueError):
            compare_on_shared_scans(tables, [("p", before, after)])
