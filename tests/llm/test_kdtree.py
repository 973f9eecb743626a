import math
import random

import duckdb
import pytest

from queryproof.llm import kdtree
from queryproof.llm.queries import SQL


def brute(rows, k=5, every=50):
    part = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in part:
        if q % every == 0:
            scores = {(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in part if i != q and len(a) == len(b)}
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_ties_bad_values_and_lengths(spark, rows_of):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(400)]
    rows += [(450, None), (500, [0.1, None, 0.2]), (550, [math.nan, 0.0, 1.0]), (401, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (600, [0.5, 0.5]), (601, [0.1, -0.1]), (650, []), (651, []), (700, [1.0]), (-50, [0.3, -0.3, 0.3])]
    rows += [(7, rows[7][1]), (50, rows[50][1])]
    df = rows_of("vec_id long, embedding array<double>, rank string", [(*r, "x") for r in rows])
    got = kdtree.top_k(df.repartition(4), shard_rows=30, block_rows=3, leaf=4, most_trees=3, most_blocks=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert kdtree.top_k(df.limit(0)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i * 3.7), -float(2**19 + i)]) for i in range(120)]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=50, leaf=8)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_the_walk_skips_boxes():
    np = kdtree.np
    points = np.random.default_rng(0).normal(0, 1000, (4000, 3)).astype(np.int64)
    tree = kdtree.Tree(np.arange(4000), points, 16)
    for node, (a, b) in enumerate(tree.span):
        assert (tree.points[a:b].min(0) == tree.low[node]).all() and (tree.points[a:b].max(0) == tree.high[node]).all()
    query = np.array([5, -3, 2])
    seen = []
    tree.span = type("Spy", (list,), {"__getitem__": lambda self, i: seen.append(i) or list.__getitem__(self, i)})(tree.span)
    bounds, best = np.maximum(query, 0) @ tree.high.T + np.minimum(query, 0) @ tree.low.T, []
    tree.search(-1, query, bounds, best, 5, None)
    assert sorted(s for s, _ in best) == sorted((tree.points @ query).tolist())[-5:]
    assert len(seen) < 40


def test_repeated_rows_count_once(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1, 201)]
    rows += [rows[49]] * 6 + [rows[99]] * 3  # queries
    rows += [(300, [3 * x for x in rows[49][1]])] * 9 + [(301, [2 * x for x in rows[99][1]])] * 9  # their best candidates
    for shape in ({}, {"shard_rows": 20, "block_rows": 3, "leaf": 4, "most_trees": 3, "most_blocks": 2}):
        got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), **shape)
        assert {tuple(r) for r in got.collect()} == brute(rows)


def test_one_id_with_many_vectors(spark):
    rows = [(50, [1.0, 0.0]), *((i, [float(i), 0.0]) for i in range(1, 9)), *((60, [9.0, float(j)]) for j in range(8))]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), leaf=2)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_binaries_meet_without_a_join_of_pairs(spark):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    out = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    # the cogroup sorts each side by its three small keys; no row ever holds a block and a tree
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow")[1]
    assert not [line for line in plan.splitlines() if "block#" in line and "tree#" in line and "CoGroups" not in line]


def test_what_does_not_fit_is_an_error(spark):
    for big in (1e19, 2.0**31):
        df = spark.createDataFrame([(50, [big, big]), (1, [big, big])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large"):
            kdtree.top_k(df).collect()


def test_the_sql_counts_repeated_rows_once():
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    rows = [(50, [1.0, 0.5]), (50, [1.0, 0.5]), *[(1, [2.0, 0.0])] * 3, *((i, [i / 10, 0.1]) for i in range(2, 9))]
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert {tuple(r) for r in con.execute(SQL["op5_kdtree_top_k"]).fetchall()} == brute(rows)
