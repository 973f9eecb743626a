"""Ranks and picks against brute force, with a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from queryproof.operators import selection
from queryproof.operators.joins import exists_in, not_exists_in, outer_join
from queryproof.operators.pool import candidate_pool
from queryproof.operators.ranking import ranked_rows, top_per_key


def skewed(n=600, seed=1):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.05 else (0 if rng.random() < 0.35 else rng.randrange(1, 40)), rng.randrange(8), i) for i in range(n)]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_ranked_rows(spark, direction):
    rows = skewed()
    df = spark.createDataFrame(rows, "k bigint, b bigint, i bigint").repartition(7)
    got = {r["i"]: r["rn"] for r in ranked_rows(df, ["k"], [("b", direction), ("i", "asc")]).collect()}
    sign = 1 if direction == "asc" else -1
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (sign * r[1], r[2]))
        want.update({r[2]: n for n, r in enumerate(ordered, 1)})
    assert got == want


def test_numbering_without_keys_gathers_nothing(spark, t):
    ranked = ranked_rows(t.orders, [], [("o_orderdate", "asc"), ("o_orderkey", "asc")])
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_top_per_key_is_pruned_before_the_shuffle(t):
    top = top_per_key(t.orders, ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


CANDIDATE = (
    "k bigint, candidate_id string, pos bigint, semantic_match boolean, effective_change boolean, patchability int, "
    "canonical int, improved boolean, after_cost double, tier string"
)


def candidates(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.35 else rng.randrange(1, 60)
        out.append(
            (key, f"c{i}", i, rng.random() < 0.6, rng.random() < 0.7, rng.choice([50, 60, 80]), rng.choice([0, 6]),
             rng.choice([True, False, None]), rng.choice([None, 1.0, 2.0]), rng.choice(["HIGH", "LOW"]))
        )
    return out


def rank(c):
    cost = float("inf") if c[8] is None else c[8]
    return (int(c[4]), c[5], c[6], int(bool(c[7])), -cost)


def scan(rows):
    """The selection loop over one key, candidate by candidate."""
    best = fallback = runner = None
    for c in rows:
        if c[3]:
            if best is None or rank(c) > rank(best):
                runner, best = best, c
            elif runner is None:
                runner = c
        if fallback is None or rank(c) > rank(fallback):
            fallback = c
    return best, fallback, runner


@pytest.mark.parametrize("seed", range(3))
def test_selection(spark, seed):
    rows = candidates(seed)
    df = spark.createDataFrame(rows, CANDIDATE).repartition(6)
    got = {r["k"]: (r["selected_id"], r["selected_by"]) for r in selection.select_best(df, "k", ["pos"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        best, fallback, _ = scan(mine)
        want[key] = ((best or fallback)[1], "MATCH" if best else "FALLBACK")
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_runner_ups(spark, seed):
    rows = candidates(seed)
    df = spark.createDataFrame(rows, CANDIDATE).repartition(6)
    scanned = {r["k"]: r["runner_up_id"] for r in selection.runner_up_by_scan(df, "k", ["pos"]).collect()}
    second = {r["k"]: r["runner_up_id"] for r in selection.runner_up(df, "k", ["pos"]).collect()}
    want_scan, want_second = {}, {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        runner = scan(mine)[2]
        if runner:
            want_scan[key] = runner[1]
        ordered = sorted((r for r in mine if r[3]), key=lambda r: (tuple(-v for v in rank(r)), r[2]))
        if len(ordered) > 1:
            want_second[key] = ordered[1][1]
    assert scanned == want_scan
    assert second == want_second


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_equal_sparks_own(spark, how):
    left = spark.createDataFrame([(r[0], r[2]) for r in skewed(200, 2)], "a bigint, x bigint")
    right = spark.createDataFrame([(r[0], r[2]) for r in skewed(120, 3)] + [(77, 1)], "b bigint, y bigint")
    ours = outer_join(left, "a", right, "b", how, hot="right" if how == "left" else "left")
    assert sorted(map(str, ours.collect())) == sorted(map(str, outer_join(left, "a", right, "b", how).collect()))
    plain = left.join(right, F.col("a") == F.col("b"), how)
    assert ours.exceptAll(plain).count() == plain.exceptAll(ours).count() == 0


def test_semi_and_anti_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a bigint")
    right = spark.createDataFrame([(2,), (2,), (None,)], "b bigint")
    assert [r["a"] for r in exists_in(left, "a", right, "b").collect()] == [2]
    assert {r["a"] for r in not_exists_in(left, "a", right, "b").collect()} == {1, None}


def test_candidate_pool(spark):
    schema = "key string, position bigint, text string"
    generated = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, ""), ("t", 1, "a")], schema)
    rules = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], schema)
    ids = {r["candidate_id"] for r in candidate_pool([("llm", generated), ("rule", rules)]).collect()}
    assert ids == {"s:llm:c1", "t:llm:c1", "s:rule:c2"}
