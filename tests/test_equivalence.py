"""Metamorphic tests: equal inputs match, every kind of perturbation is noticed."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryproof.functions.canon import row_text
from queryproof.operators import equivalence as eq
from queryproof.plans.registry import PAIRS, load_all
from queryproof.session import scratch_path

ALGORITHMS = ["native", "md5"]
load_all()


def status(before, after, **kw):
    row = eq.compare_bags(before, after, **kw).collect()[0]
    return row["count_status"], row["fingerprint_status"]


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_pairs_match_and_notice_a_repeated_row(name, t):
    before, after = PAIRS[name](t)
    report = eq.pair_report(name, before, after).collect()[0]
    assert report["status"] == "MATCH" and not report["vacuous"]
    more = after.unionByName(after.limit(1))
    assert eq.pair_report(name, before, more).collect()[0]["status"] == "MISMATCH"


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_perturbations(t, algorithm):
    o = t.orders
    changed = o.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") == 77, "Z").otherwise(F.col("o_orderstatus"))
    )
    assert status(o, o, algorithm=algorithm) == ("MATCH", "MATCH")
    assert status(o, changed, algorithm=algorithm) == ("MATCH", "MISMATCH")
    assert status(o, o.filter("o_orderkey <> 5"), algorithm=algorithm) == ("MISMATCH", "SKIPPED")
    swapped = o.filter("o_orderkey <> 5").unionByName(o.filter("o_orderkey = 6"))
    assert status(o, swapped, algorithm=algorithm) == ("MATCH", "MISMATCH")


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_partitioning_and_order_do_not_matter(t, algorithm):
    prints = {
        eq.bag_fingerprint(df, algorithm=algorithm).collect()[0]["fingerprint"]
        for df in (t.lineitem, t.lineitem.repartition(1), t.lineitem.repartition(17), t.lineitem.orderBy("l_tax"))
    }
    assert len(prints) == 1


SCHEMA = T.StructType(
    [
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("xs", T.ArrayType(T.StringType())),
        T.StructField("m", T.MapType(T.StringType(), T.LongType())),
        T.StructField("raw", T.BinaryType()),
        T.StructField("d", T.DoubleType()),
    ]
)
DISTINCT_ROWS = [
    ("x", None, None, None, None, 0.0),
    (None, "x", None, None, None, 0.0),
    ("x|S1:y", None, None, None, None, 0.0),
    ("x", "y", None, None, None, 0.0),
    ("N", None, None, None, None, 0.0),
    ("", None, None, None, None, 0.0),
    (None, None, None, None, None, 0.0),
    (None, None, [], None, None, 0.0),
    (None, None, [None], None, None, 0.0),
    (None, None, [None, "a"], None, None, 0.0),
    (None, None, ["a", None], None, None, 0.0),
    (None, None, ["a|S1:b"], None, None, 0.0),
    (None, None, ["a", "b"], None, None, 0.0),
    (None, None, None, {}, None, 0.0),
    (None, None, None, {"k": 1}, None, 0.0),
    (None, None, None, {"k": None}, None, 0.0),
    (None, None, None, None, bytearray(b""), 0.0),
    (None, None, None, None, bytearray(b"\x00"), 0.0),
    (None, None, None, None, None, None),
    (None, None, None, None, None, float("nan")),
    (None, None, None, None, None, 1e-300),
]


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_different_rows_have_different_fingerprints(spark, algorithm):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(DISTINCT_ROWS)], T.StructType([T.StructField("i", T.LongType())] + SCHEMA.fields))
    from queryproof.functions.canon import row_hash

    hashes = df.select(row_hash(df, SCHEMA.names, algorithm).alias("h")).distinct().count()
    assert hashes == len(DISTINCT_ROWS)


def test_equal_values_have_equal_text(spark):
    rows = [({"a": 1, "b": 2}, -0.0, Decimal("1.50")), ({"b": 2, "a": 1}, 0.0, Decimal("1.5"))]
    df = spark.createDataFrame(rows, "m map<string,bigint>, d double, p decimal(12,2)")
    assert df.select(row_text(df).alias("x")).distinct().count() == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    hs.lists(hs.tuples(hs.one_of(hs.none(), hs.text(alphabet="aN|S:1é", max_size=3)), hs.integers(-2, 2)), max_size=12),
    hs.lists(hs.tuples(hs.one_of(hs.none(), hs.text(alphabet="aN|S:1é", max_size=3)), hs.integers(-2, 2)), max_size=12),
)
def test_bags_match_exactly_when_equal(spark, left, right):
    schema = "s string, n bigint"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    same = sorted(map(repr, left)) == sorted(map(repr, right))
    for algorithm in ALGORITHMS:
        assert (eq.pair_report("x", a, b, algorithm).collect()[0]["status"] == "MATCH") == same
    want = {r: (left.count(r), right.count(r)) for r in set(left) | set(right) if left.count(r) != right.count(r)}
    for path in (None, scratch_path(spark, "diff")):
        differing = {(r["s"], r["n"]): (r["n_before"], r["n_after"]) for r in eq.diff_rows(a, b, path).collect()}
        assert differing == want


def test_grouped_comparison_and_ledger(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k bigint, v string")
    b = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (4, "d")], "k bigint, v string")
    got = {r["k"]: (r["count_status"], r["fingerprint_status"]) for r in eq.compare_bags(a, b, ["k"]).collect()}
    assert got == {
        1: ("MATCH", "MATCH"),
        2: ("MATCH", "MISMATCH"),
        3: ("MISMATCH", "SKIPPED"),
        4: ("MISMATCH", "SKIPPED"),
    }
    ledger = eq.evidence_ledger(eq.compare_bags(a, b, ["k"]), ["k"]).filter("k = 1").collect()
    assert {(r["source"], r["match_strength"]) for r in ledger} == {("DB_COUNT", "EXACT"), ("DB_FINGERPRINT", "EXACT")}


def test_ordered_comparison(spark):
    rows = [(i % 3, i) for i in range(30)]
    df = spark.createDataFrame(rows, "b bigint, v bigint")
    up, down = [("b", "asc"), ("v", "asc")], [("b", "asc"), ("v", "desc")]
    same = eq.compare_ordered(df, up, df.repartition(5), up).collect()[0]
    assert (same["n_positions_different"], same["ordered_status"]) == (0, "MATCH")
    other = eq.compare_ordered(df, up, df, down).collect()[0]
    assert (other["n_positions_different"], other["ordered_status"]) == (30, "MISMATCH")
    assert eq.compare_ordered_bags(df, up, df, up).collect()[0]["fingerprint_status"] == "MATCH"
    assert eq.compare_ordered_bags(df, up, df, down).collect()[0]["fingerprint_status"] == "MISMATCH"


def test_changed_cells(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k bigint, s string, n bigint")
    b = spark.createDataFrame([(1, "a", 7), (2, "c", 5)], "k bigint, s string, n bigint")
    got = {tuple(r) for r in eq.changed_cells(a, b, ["k"]).collect()}
    assert got == {(1, "CHANGED", "n", None, "7"), (2, "CHANGED", "s", "b", "c")}
    a = a.union(spark.createDataFrame([(3, "d", 1), (None, "n", 1), (5, "x", 1), (5, "y", 1)], a.schema))
    b = b.union(spark.createDataFrame([(4, "d", 1), (None, "n", 2), (5, "x", 1)], b.schema))
    got = {tuple(r) for r in eq.changed_cells(a, b, ["k"]).collect()}
    assert got == {
        (1, "CHANGED", "n", None, "7"), (2, "CHANGED", "s", "b", "c"), (3, "DELETED", None, None, None),
        (4, "INSERTED", None, None, None), (None, "CHANGED", "n", "1", "2"), (5, "DUPLICATE_KEY", None, None, None),
    }


SAME_VALUES = [
    ("tinyint", "smallint"), ("int", "bigint"), ("int", "decimal(12,2)"), ("decimal(12,2)", "decimal(20,2)"),
    ("decimal(20,4)", "bigint"), ("float", "double"), ("int", "double"), ("decimal(5,1)", "double"),
    ("string", "varchar(9)"), ("date", "timestamp_ntz"),
]


@pytest.mark.parametrize("algorithm", ["native", "md5"])
@pytest.mark.parametrize("types", SAME_VALUES, ids="/".join)
def test_values_count_and_not_their_types(spark, types, algorithm):
    text = ["2020-01-02", "2021-03-04", None] if "date" in types else ["1", "5", None]
    one, other = (spark.createDataFrame([(v,) for v in text], "v string").select(F.col("v").cast(k)) for k in types)
    for a, b in ((one, other), (other, one)):
        assert eq.pair_report("p", a, b, algorithm).collect()[0]["status"] == "MATCH"
        assert eq.compare_batch([("p", a, b)], algorithm).collect()[0]["status"] == "MATCH"
        changed = b.filter("v IS NULL").union(b.limit(2).union(b.limit(0)))
        assert eq.pair_report("p", a, b.union(b.limit(1)), algorithm).collect()[0]["status"] == "MISMATCH"
        assert eq.diff_rows(a, b).count() == 0 and changed.count() >= 1


NUMBERS_AND_DOUBLES = [
    ("bigint", "9007199254740993", "9007199254740992", False), ("bigint", "4611686018427387904", "4611686018427387904", True),
    ("bigint", "9223372036854775807", "9223372036854775807", False), ("bigint", "-9007199254740994", "-9007199254740994", True),
    ("decimal(38,20)", "0.12345678901234567891", "0.12345678901234567891", False), ("decimal(10,2)", "0.10", "0.1", True),
    ("decimal(10,2)", "0.33", "0.333", False), ("decimal(38,0)", "1000000000000000000000000000000", "1e30", True),
    ("decimal(38,0)", "1000000000000000000000000000001", "1e30", False), ("int", "0", "-0.0", True), ("int", "1", "NaN", False),
]


@pytest.mark.parametrize("algorithm", ["native", "md5"])
@pytest.mark.parametrize("kind, number, double, same", NUMBERS_AND_DOUBLES)
def test_numbers_against_doubles(spark, kind, number, double, same, algorithm):
    a, b = (spark.createDataFrame([(v,)], "v string").select(F.col("v").cast(k)) for v, k in ((number, kind), (double, "double")))
    for left, right in ((a, b), (b, a)):
        assert eq.pair_report("p", left, right, algorithm).collect()[0]["status"] == ("MATCH" if same else "MISMATCH")
        assert (eq.diff_rows(left, right).count() == 0) == same


NESTED = [
    ("array(1, 2, null)", "array(1L, 2L, null)", "array(1L, 3L, null)"), ("map('a', 1)", "map('a', 1L)", "map('a', 2L)"),
    ("named_struct('x', 1, 'y', array(1.5BD))", "named_struct('z', 1L, 'y', array(1.50BD))", "named_struct('z', 1L, 'y', array(1.51BD))"),
    ("array(named_struct('x', 1))", "array(named_struct('x', 1D))", "array(named_struct('x', 1.5D))"), ("cast(null AS array<int>)", "cast(null AS array<bigint>)", "array(1L)"),
    ("named_struct(\"it's\", 1)", "named_struct('b', 1L)", "named_struct('b', null)"), ("array(null)", "array(cast(null AS int))", "array(1)"),
]


@pytest.mark.parametrize("algorithm", ["native", "md5"])
@pytest.mark.parametrize("one, other, changed", NESTED)
def test_nested_values_of_unequal_widths(spark, one, other, changed, algorithm):
    a, b, c = (spark.range(1).selectExpr(f"{x} AS v") for x in (one, other, changed))
    for left, right in ((a, b), (b, a)):
        assert eq.pair_report("p", left, right, algorithm).collect()[0]["status"] == "MATCH"
    assert eq.pair_report("p", a, c, algorithm).collect()[0]["status"] == "MISMATCH"


@pytest.mark.parametrize("one, other", [("array(1)", "array('a')"), ("named_struct('x', 1)", "named_struct('x', 1, 'y', 2)"), ("timestamp'2020-01-01'", "timestamp_ntz'2020-01-01'")])
def test_values_that_are_not_compared(spark, one, other):
    a, b = (spark.range(1).selectExpr(f"{x} AS v") for x in (one, other))
    with pytest.raises(ValueError, match="can't be compared"):
        eq.pair_report("p", a, b)


def test_types_without_common_values_are_an_error(spark):
    a, b = spark.range(1).selectExpr("id"), spark.range(1).selectExpr("cast(id as string) AS id")
    with pytest.raises(ValueError, match="can't be compared"):
        eq.pair_report("p", a, b)


def test_vacuous_matches_are_marked(t):
    none = t.orders.filter("o_orderkey < 0")
    assert eq.pair_report("x", none, none).collect()[0]["vacuous"]


def test_batch_reports_every_pair(t):
    o, none = t.orders, t.orders.filter("o_orderkey < 0")
    pairs = [("same", o, o), ("fewer", o, o.filter("o_orderkey > 3")), ("empty", none, none.select(*o.columns)), ("one", none, o.limit(1))]
    got = {r["pair_id"]: (r["status"], r["vacuous"]) for r in eq.compare_batch(pairs).collect()}
    assert got == {"same": ("MATCH", False), "fewer": ("MISMATCH", False), "empty": ("MATCH", True), "one": ("MISMATCH", False)}


def test_samples_pick_the_same_keys(t):
    left = eq.key_sample(t.lineitem, ["l_orderkey"], 10, 3)
    right = eq.key_sample(t.lineitem.repartition(9).withColumn("l_tax", F.lit(1.0)), ["l_orderkey"], 10, 3)
    keys = [df.select("l_orderkey").distinct() for df in (left, right)]
    assert keys[0].exceptAll(keys[1]).count() == keys[1].exceptAll(keys[0]).count() == 0
    assert 0 < left.count() < t.lineitem.count()


def test_schema_differences(t):
    assert eq.schema_differences(t.orders, t.orders) == []
    assert len(eq.schema_differences(t.orders, t.orders.withColumnRenamed("o_custkey", "x"))) == 1


def test_pairs_share_sides_and_hashes(spark):
    rows = [(1, [1, None], {"k": 5, "a|": 1}, ([2], "x")), (2, [], None, None), (3, None, {}, ([None, None], None))]
    a, b = (spark.createDataFrame(rows, f"n {n}, l array<{n}>, m map<string,{n}>, s struct<i:array<{n}>,t:string>") for n in ("int", "bigint"))
    c = b.withColumn("n", F.expr("n + cast(n = 2 as bigint)"))
    d = b.withColumn("n", F.col("n").cast("double"))
    pairs = [("it's", a, b), ("changed", a, c), ("turned", b, a), ("real", a, d), ("none", a.limit(0), b.limit(0))]
    found = eq.pair_reports(pairs, ("md5", "native"))
    got = {(r.algorithm, r.pair_id): tuple(r)[1:] for r in found.collect()}
    assert got == {(how, p[0]): tuple(eq.pair_report(*p, algorithm=how).first()) for p in pairs for how in ("md5", "native")}
    assert [got["md5", p[0]][5:] for p in pairs] == [("MATCH", False), ("MISMATCH", False), ("MATCH", False), ("MATCH", False), ("MATCH", True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 5  # a against two types, b, c and d; the empty ones read nothing


def test_text_of_nested_values_needs_no_lambda_for_plain_items(spark):
    df = spark.sql("SELECT * FROM VALUES (array(1, NULL, -3)), (array()), (array(CAST(NULL AS INT))), (NULL) AS t(l)")
    text = row_text(df)
    assert [r[0] for r in df.select(text).collect()] == ["[V1|N|V-3]", "[]", "[N]", "N"]
    assert "lambda" not in df.select(text)._jdf.queryExecution().optimizedPlan().toString()
