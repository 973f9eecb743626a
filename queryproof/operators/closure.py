"""Transitive closure of references between fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A round may meet so many pairs for each one it has to read anyway.
SPREAD = 4


def reference_closure(roots: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """``(root, n_refs, max_level, degraded)`` for every root.

    ``roots`` holds ``root``; ``edges`` holds ``(fragment, ref)``, where a fragment without references
    has one row with a NULL ``ref``. References of a root are level 0, and ``max_level`` is the level of
    the one that takes most steps. A root is degraded if its references run into a cycle.

    Each round follows the references found last and keeps those that are new to their root, until there
    are none; a cycle is walked once. If every fragment with references is a root, what the rounds found
    serves as steps: references at exactly k steps go on by up to k, so rounds double their reach. Where
    that would meet many more pairs than there are, they go on by half as much, down to single steps.
    Otherwise there are as many rounds as the longest chain, however long. Rounds are written below
    ``path`` and read back, so no plan grows with the depth and a lost executor costs one round. The
    driver sees nothing but counts.
    """
    spark = edges.sparkSession
    links = edges.filter(F.col("ref").isNotNull()).select("fragment", "ref").distinct()
    schema = roots.select("root", F.col("root").alias("at")).schema.add("level", "integer")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    links = kept(links, "links/all")
    starts = roots.select("root").distinct()
    everywhere = links.join(starts, F.col("fragment") == F.col("root"), "left_anti").isEmpty()
    first = links.join(starts, F.col("fragment") == F.col("root")).select("root", F.col("ref").alias("at"), F.lit(0).alias("level"))
    frontier = kept(first, "reached/round=000000")
    reached = spark.read.schema(schema).parquet(f"{path}/reached")
    n_reached, far, no = frontier.count(), 1, 1  # all references within ``far`` steps are known
    while not frontier.isEmpty():
        reach = _stride(frontier, reached, far, SPREAD * n_reached) if everywhere else 1
        near = reached.filter(F.col("level") < reach).select(F.col("root").alias("fragment"), F.col("at").alias("ref"), F.col("level").alias("more"))
        steps = near if reach > 1 else links.withColumn("more", F.lit(0))
        step = frontier.select("root", F.col("at").alias("fragment")).join(steps, "fragment")
        step = step.groupBy("root", F.col("ref").alias("at")).agg((F.min("more") + far).cast("int").alias("level"))
        found = kept(step.join(reached.select("root", "at"), ["root", "at"], "left_anti"), f"reached/round={no:06d}")
        n_reached, far, no = n_reached + found.count(), far + reach, no + 1
        frontier = found.filter(F.col("level") == far - 1)
        reached = spark.read.schema(schema).parquet(f"{path}/reached")
    if everywhere:
        circles = reached.filter("root = at").select("at")
        endless = reached.join(circles, "at", "left_semi").select(F.col("root").alias("_endless")).distinct()
    else:
        endless = running_in_circles(links, kept).select(F.col("fragment").alias("_endless"))
    counted = reached.groupBy("root").agg(F.count("*").alias("n_refs"), F.max("level").alias("max_level"))
    return (
        roots.join(counted, "root", "left")
        .join(endless, F.col("root") == F.col("_endless"), "left")
        .select(
            "root",
            F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
            F.col("max_level").cast("int").alias("max_level"),
            F.col("_endless").isNotNull().alias("degraded"),
        )
    )


def _stride(frontier: DataFrame, reached: DataFrame, far: int, most: int) -> int:
    """``far``, or what is left of it after some halvings, whose steps from the frontier meet at most ``most`` pairs, at least 1."""
    if far == 1:
        return 1
    reaches = [far]
    while reaches[-1] > 1:
        reaches.append(reaches[-1] // 2)
    here = frontier.groupBy(F.col("at").alias("fragment")).agg(F.count("*").alias("_n"))
    sizes = [F.count_if(F.col("level") < r).alias(f"_{r}") for r in reaches]
    there = reached.groupBy(F.col("root").alias("fragment")).agg(*sizes)
    met = here.join(there, "fragment").agg(*(F.sum(F.col("_n").cast("double") * F.col(f"_{r}")) for r in reaches)).first()
    return next((r for r, n in zip(reaches, met) if (n or 0) <= most), 1)


def running_in_circles(links: DataFrame, kept) -> DataFrame:
    """``(fragment)`` of those that lead into a cycle: what is left after taking away, again and again,
    the links to where no link starts."""
    links = kept(links, "links/round=0")
    count, before, no = links.count(), -1, 1
    while count and count != before:
        starts = links.select(F.col("fragment").alias("ref")).distinct()
        links = kept(links.join(starts, "ref", "left_semi").select("fragment", "ref"), f"links/round={no}")
        before, count, no = count, links.count(), no + 1
    return links.select("fragment").distinct()
