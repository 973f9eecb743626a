"""Reach, stored sketches, merged snapshots and expiring state against plain recomputation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queryproof.operators.keysketch import SketchStore, parts_for, set_counts
from queryproof.operators.reach import keeper, reach_counts, strong_components
from queryproof.operators.snapshots import SnapshotStore, quantiles
from queryproof.sources.jsonl import write_jsonl
from queryproof.streaming import eventlog as log


def reached(start, links):
    """What start reaches by at least one step."""
    seen, todo = set(), [start]
    while todo:
        for ref in links.get(todo.pop(), ()):
            if ref not in seen:
                seen.add(ref)
                todo.append(ref)
    return seen


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EDGES = [
    *((100 + i, 100 + (i + 1) % 5) for i in range(5)), (102, 110), (110, 111), (111, 110), (99, 100), (98, 99),  # a circle that leads into another
    (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 5), (6, 5), (200, 200), (201, 200), (300, None), (301, 302), (301, 302),
]


def test_reach_and_components_agree_with_walking(spark, tmp_path, few_partitions):
    df = spark.createDataFrame(EDGES, "fragment long, ref long")
    links = {}
    for a, b in EDGES:
        if b is not None:
            links.setdefault(a, set()).add(b)
    nodes = {n for e in EDGES for n in e if n is not None} | {999}
    reach = {n: reached(n, links) for n in nodes}
    got = {r.node: r.component for r in strong_components(df.filter("ref IS NOT NULL").distinct(), keeper(spark, f"{tmp_path}/scc")).collect()}
    for n in nodes:
        mates = {m for m in reach[n] if n in reach[m]} | {n}
        assert got.get(n) == (max(mates) if len(mates) > 1 else None)
    out = reach_counts(spark.createDataFrame([(n,) for n in nodes], "root long"), df, f"{tmp_path}/reach")
    circles = {n for n in nodes if n in reach[n]}
    for r in out.collect():
        assert (r.n_refs, r.on_cycle, r.degraded) == (len(reach[r.root]), r.root in circles, bool(circles & (reach[r.root] | {r.root})))


def test_long_runs_take_few_rounds(spark, tmp_path, few_partitions):
    """Chains and circles as long as 64 are passed in doublings; what branches off, comes in or runs beside them counts."""
    edges = [
        *((i, i + 1) for i in range(64)), (70, 20), (40, 71), (71, 72), (72, 50), (40, 73), (73, 50),  # a chain, a way in, ways beside it
        *((100 + i, 100 + (i + 1) % 40) for i in range(40)), (150, 151), (151, 110), (130, 152), (152, 153), (153, 30),  # a circle, into it, out of it
        (105, 154), (154, 155), (155, 120), *((200 + i, 200 + (i + 1) % 33) for i in range(33)), (240, 240),  # a way within it, circles of their own
    ]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    nodes = {n for e in edges for n in e}
    reach = {n: reached(n, links) for n in nodes}
    circles = {n for n in nodes if n in reach[n]}
    roots = spark.createDataFrame([(n,) for n in nodes], "root long")
    rows = reach_counts(roots, spark.createDataFrame(edges, "fragment long, ref long"), f"{tmp_path}/runs").collect()
    assert sorted(r.root for r in rows) == sorted(nodes)
    for r in rows:
        assert (r.n_refs, r.on_cycle, r.degraded) == (len(reach[r.root]), r.root in circles, bool(circles & reach[r.root])), r
    assert len(list((tmp_path / "runs").glob("*/*"))) < 64


def test_reach_of_many_is_within_the_error(spark, tmp_path, few_partitions):
    edges = spark.range(300).selectExpr("id AS fragment", "300 + id AS ref").union(spark.range(300).selectExpr("-1L", "id"))
    (row,) = reach_counts(spark.createDataFrame([(-1,)], "root long"), edges, f"{tmp_path}/wide").collect()
    assert abs(row.n_refs - 600) < 4 * 0.017 * 600 and not row.degraded


def test_no_edges(spark, tmp_path, few_partitions):
    none = spark.createDataFrame([], "fragment long, ref long")
    (row,) = reach_counts(spark.createDataFrame([(1,)], "root long"), none, f"{tmp_path}/none").collect()
    assert tuple(row) == (1, 0, False, False)


@pytest.mark.parametrize("lg, error", [(14, 0), (6, 0.5)])
def test_stored_sets(spark, tmp_path, few_partitions, lg, error):
    rng = random.Random(lg)
    rows = [(rng.choice("abc"), rng.randrange(3000)) for _ in range(9000)] + [("a", None), (None, 5)]
    store = SketchStore(spark, str(tmp_path / "s"), lg)
    df = spark.createDataFrame(rows, "run string, key long")
    store.write(df.filter("key < 100"), "run", "key")
    store.write(df.filter("run = 'b'"), "run", "key")  # replaces its own run only
    store.write(df.filter("run <> 'b'"), "run", "key")
    sets = {r: {k for q, k in rows if q == r and k is not None} for r in "abc"}
    pairs = [("a", "b"), ("b", "c"), ("c", "c"), ("a", "none"), ("none", "a"), ("none", "nothing")]
    for r in set_counts(store.read(), pairs).collect():
        a, b = sets.get(r.first, set()), sets.get(r.second, set())
        want = (len(a), len(b), len(a & b), len(a - b), len(a | b))
        assert all(abs(g - w) <= error * max(len(a), len(b)) for g, w in zip(tuple(r)[2:], want))


@pytest.mark.parametrize("keys, lg, parts", [(40_000, 17, 1), (40_000, 8, parts_for(40_000, 8))])
def test_stored_sets_of_many_keys(spark, tmp_path, few_partitions, keys, lg, parts):
    store = SketchStore(spark, str(tmp_path / "s"), lg, parts)
    for run, low, high in (("a", 0, keys * 3 // 4), ("b", keys // 4, keys)):
        store.write(spark.range(low, high).selectExpr(f"'{run}' AS run", "id AS key"), "run", "key")
    (row,) = set_counts(store.read(), [("a", "b")], lg).collect()
    assert tuple(row)[2:] == (keys * 3 // 4, keys * 3 // 4, keys // 2, keys // 4, keys)


def test_snapshots_merge_and_replays_replace(spark, tmp_path, few_partitions):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), rng.uniform(-5, 5), i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "code string, value double, batch int")
    store = SnapshotStore(spark, str(tmp_path / "snap"), ["code"])
    store.write(df.limit(7), 3, "value")
    for b in range(5):
        store.write(df.filter(F.col("batch") == b).drop("batch"), b, "value")
    whole = {r.code: (r.n, r.total) for r in df.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total")).collect()}
    assert {r.code: (r.n, r.total) for r in store.snapshot().collect()} == whole
    part = df.filter("batch < 2").groupBy("code").count().collect()
    assert {r.code: r.n for r in store.snapshot([0, 1]).collect()} == {r.code: r["count"] for r in part}
    for r in quantiles(store.snapshot(), ["code"], [0.05, 0.5, 0.95]).collect():
        values = sorted(v for c, v, _ in rows if c == r.code)
        assert abs(sum(v <= r.value for v in values) / len(values) - r.p) < 0.02
    delta = {r.code: (r.baseline, r.candidate, r.delta) for r in store.delta([0], [4]).collect()}
    for code, (base, cand, diff) in delta.items():
        n = [sum(c == code and b == at for c, _, b in rows) for at in (0, 4)]
        assert (base, cand, diff) == (*n, n[1] - n[0])


def test_late_rows_and_expiry(spark, tmp_path, few_partitions):
    start = datetime(2024, 1, 1)

    def rows(days, code):
        return spark.createDataFrame([(start + timedelta(days=d), code) for d in days], "ts timestamp, code string")

    got = {}

    def keep(batch, _):
        got.update({(r.window_start.day, r.code): r.n for r in batch.collect()})

    schema = rows([0], "a").schema
    for days in ([0, 1, 2, 9], [1, 8.5, 9], [0]):  # the watermark stands at day 8 after the first
        write_jsonl(rows(days, "a"), f"{tmp_path}/log", append=True)
        stream = log.read_event_log(spark, f"{tmp_path}/log", schema)
        log.run_batches(log.windowed_counts(stream, "ts", ["code"], "2 days", "1 day"), "update", f"{tmp_path}/cp", keep)
    by_bucket = sorted(n for n in got.values())
    assert sum(by_bucket) == 6 and max(by_bucket) >= 2  # days 1 and 0 of the later files came too late
    left = log.stored_state(spark, f"{tmp_path}/cp").select("key.*", "value.*").collect()
    assert len(left) == 1 and left[0]["count"] == 3 and left[0]["window"].end > start + timedelta(days=8)
