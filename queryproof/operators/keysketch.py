"""Sets of keys kept as sketches of bounded size, and what any two runs have in common.

A theta sketch of 2**lg entries is exact while a set has fewer keys than that; beyond it, the relative standard
error of a count is some 1 / sqrt(2**lg) of the larger set. Keys may be dealt by hash into parts with a sketch
each, which makes counts exact up to some ``parts`` times 2**lg keys: equal keys of two runs lie in equal
parts, so counts of parts add up. Sketches are written once a run; comparing runs reads them alone, never the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parts_for(rows: int, lg: int = 16) -> int:
    """Parts that hold so many keys exactly: half of 2**lg in each on average, so that no part runs over."""
    return max(1, -(-rows // (1 << lg - 1)))


def run_sketches(df: DataFrame, run: str, key: str, lg: int = 16, parts: int = 1) -> DataFrame:
    """``(run, part, keys)``: one aggregation, whose tasks send one sketch a run and part. NULL keys are not counted."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    return df.groupBy(F.col(run).alias("run"), part).agg(F.theta_sketch_agg(key, lg).alias("keys"))


class SketchStore:
    """Sketches by run below one folder, all of the same number of parts. Writing a run again replaces it."""

    def __init__(self, spark: SparkSession, path: str, lg: int = 16, parts: int = 1):
        self.spark, self.path, self.lg, self.parts = spark, path, lg, parts

    def write(self, df: DataFrame, run: str, key: str) -> None:
        """Store the runs that ``df`` holds. A folder is a run, so a replay changes nothing."""
        sketches = run_sketches(df, run, key, self.lg, self.parts).select(F.col("run").cast("string").alias("run_id"), "part", "keys")
        writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run_id").parquet(self.path)

    def read(self) -> DataFrame:
        stored = self.spark.read.schema("part int, keys binary, run_id string").parquet(self.path)
        return stored.select(F.col("run_id").alias("run"), "part", "keys")


def set_counts(sketches: DataFrame, pairs: Sequence[tuple[str, str]], lg: int = 16) -> DataFrame:
    """``(first, second, n_first, n_second, n_both, n_only_first, n_either)`` for pairs of stored runs.

    One aggregation by part picks the sketches that the pairs name, another adds the parts up. A run that is not
    stored has no keys. Unions are kept within 2**(lg + 1) entries, so they are exact where both sides are.
    """
    runs = sorted({r for pair in pairs for r in pair})
    chosen = (F.max(F.when(F.col("run") == r, F.col("keys"))).alias(f"k{i}") for i, r in enumerate(runs))
    picked = sketches.groupBy("part").agg(*chosen)

    def estimate(sketch):
        return F.theta_sketch_estimate(sketch)

    counts, rows = [], []
    for i, (first, second) in enumerate(pairs):
        a, b = (F.col(f"k{runs.index(r)}") for r in (first, second))
        n_a, n_b = (F.coalesce(estimate(k), F.lit(0)) for k in (a, b))
        found = {
            "n_first": n_a,
            "n_second": n_b,
            "n_both": F.coalesce(estimate(F.theta_intersection(a, b)), F.lit(0)),
            "n_only_first": F.coalesce(estimate(F.theta_difference(a, b)), n_a),
            "n_either": F.coalesce(estimate(F.theta_union(a, b, min(lg + 1, 26))), F.greatest(n_a, n_b)),
        }
        counts += [F.coalesce(F.sum(n), F.lit(0)).alias(f"{name}_{i}") for name, n in found.items()]
        names = (F.col(f"{name}_{i}").alias(name) for name in found)
        rows.append(F.struct(F.lit(first).alias("first"), F.lit(second).alias("second"), *names))
    return picked.agg(*counts).select(F.inline(F.array(*rows)))
