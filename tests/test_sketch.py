"""Difference sketches and ordered fingerprints against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queryproof.operators import sketch
from queryproof.operators.equivalence import compare_ordered
from queryproof.operators.sequences import MODULI, compare_sequences, ordered_fingerprint, sequence_parts


@pytest.mark.parametrize("surplus", [1, 2, 3, 7])
def test_peeling_lists_every_hash(surplus):
    rng = random.Random(surplus)
    width = 64
    want, cells = {}, Counter()
    for _ in range(90):
        h, n = rng.getrandbits(64), rng.choice([-1, 1]) * rng.randrange(1, surplus + 1)
        want[h - (h >> 63 << 64)] = n
        for place in sketch._cells(h, width):
            for i, v in enumerate((1, h >> 40, h >> 20 & 0xFFFFF, h & 0xFFFFF, sketch._check(h))):
                cells[place, i] += n * v
    table = {c: [cells[c, i] for i in range(5)] for c in range(3 * width)}
    assert sketch.peeled(table, width) == want
    assert sketch.peeled({c: [n * 2 for n in v] for c, v in table.items()}, width) == {h: 2 * n for h, n in want.items()}


def test_too_many_differences_are_told(spark):
    a = spark.range(500).selectExpr("id", "cast(id AS string) AS s")
    b = spark.range(100, 600).selectExpr("id", "cast(id AS string) AS s")
    assert sketch.listed(sketch.subtracted(*(sketch.difference_sketch(df, 60) for df in (a, b))), 60) is None
    assert sketch.sketch_report(a, b, 60).collect()[0]["status"] == "TOO_MANY"


@pytest.mark.parametrize("cells, found_by", [(6, "digests"), (900, "sketch")])
@pytest.mark.parametrize("algorithm", ["native", "md5"])
def test_sketch_rows_equal_counted_rows(spark, tmp_path, cells, found_by, algorithm):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice(["a", None, "b"])) for _ in range(600)]
    other = [*rows[20:], (1, "new"), (1, "new"), (None, None), *[(3, "b")] * 5]
    a, b = (spark.createDataFrame(r, "k bigint, s string") for r in (rows, other))
    want = Counter({r: n for r, n in (Counter(rows) - Counter(other)).items()})
    got = sketch.diff_rows_by_sketch(a, b, str(tmp_path / f"d{cells}{algorithm}"), cells, algorithm).collect()
    assert {r["found_by"] for r in got} == {found_by}
    assert {(r.k, r.s): r.n_before - r.n_after for r in got if r.n_before > r.n_after} == want
    assert {(r.k, r.s): r.n_after - r.n_before for r in got if r.n_before < r.n_after} == Counter(other) - Counter(rows)


def test_sketches_add_up(spark):
    whole = spark.range(1000).selectExpr("id % 7 AS k", "id")
    parts = [sketch.difference_sketch(whole.filter(f"id % 3 = {i}"), 30) for i in range(3)]
    added = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("cell").agg(*(F.sum(c).alias(c) for c in sketch.SUMS))
    assert sketch.subtracted(sketch.difference_sketch(whole, 30), added).count() == 0
    assert sketch.difference_sketch(whole, 30).count() <= 30
    none = whole.limit(0)
    assert sketch.sketch_report(none, none).collect()[0]["n_different"] == 0


def test_a_sketch_is_one_aggregation(spark):
    plan = sketch.difference_sketch(spark.range(100).toDF("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def horner(hashes):
    out = [len(hashes)]
    for p, b in MODULI:
        value = 0
        for h in reversed(hashes):
            value = (value * b + h) % p
        out.append(value)
    return ":".join(map(str, out))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_parts_put_together_are_the_whole(spark, partitions):
    rng = random.Random(partitions)
    df = spark.createDataFrame([(rng.randrange(50), rng.choice("abc")) for _ in range(400)], "k bigint, s string")
    from queryproof.functions.canon import row_hash

    rows = sorted((r.k, r.h) for r in df.select("k", row_hash(df).alias("h")).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_fingerprint(df, [("k", "asc")]).collect()[0]
        parts = sequence_parts(df, [("k", "asc")]).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.fingerprint == horner([h for _, h in rows]) and got.n_rows == 400
    assert parts == 1 if partitions == 1 else parts > 1


def test_sequences_agree_with_positions(spark):
    df = spark.createDataFrame([(i % 9, i, None if i % 5 else "x") for i in range(200)], "a bigint, b bigint, s string")
    for left, right in (([("a", "asc"), ("b", "asc")],) * 2, ([("a", "asc"), ("b", "asc")], [("a", "asc"), ("b", "desc")]), ([("a", "desc")], [("a", "desc")])):
        one, two = compare_sequences(df, left, df.repartition(5), right), compare_ordered(df, left, df, right)
        assert one.collect()[0]["ordered_status"] == two.collect()[0]["ordered_status"]
    changed = df.withColumn("s", F.when(F.col("b") == 77, "y").otherwise(F.col("s")))
    assert compare_sequences(df, [("b", "asc")], changed, [("b", "asc")]).collect()[0]["ordered_status"] == "MISMATCH"
    none = df.limit(0)
    row = compare_sequences(none, [("b", "asc")], df, [("b", "asc")]).collect()[0]
    assert (row.n_before, row.fp_before, row.ordered_status) == (0, "0:0:0", "MISMATCH")


def test_nothing_is_written_or_numbered(spark):
    plan = compare_sequences(*[spark.range(9).toDF("v"), [("v", "asc")]] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Scan parquet" not in plan
