"""Ranks and per-key picks that survive a key holding a large share of all rows.

* ``best_per_key`` / ``top_per_key`` filter ``row_number() <= k``; Spark prunes each group to k rows
  in every map task before the shuffle (WindowGroupLimit), so hot keys send little.
* ``pick_max`` / ``pick_min`` are plain aggregates with map-side partials.
* ``ranked_rows`` numbers *every* row; ranges of the order split a hot key over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryproof.session import scratch_path

Order = Sequence[tuple[str, str]]


def order_columns(order: Order) -> list[Column]:
    """``[("price", "desc"), ("id", "asc")]`` as sort columns; NULLs sort last both ways."""
    out = []
    for name, direction in order:
        col = F.col(name)
        out.append(col.desc_nulls_last() if direction == "desc" else col.asc_nulls_last())
    return out


def top_per_key(df: DataFrame, keys: Sequence[str], order: Order, k: int, rank_col: str = "rn") -> DataFrame:
    """The first k rows of each key in a total order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key in a total order."""
    return top_per_key(df, keys, order, 1, "_rn").drop("_rn")


def pick_max(payload: Sequence[str], rank: Sequence[Column], where: Column | None = None) -> Column:
    """Aggregate: the payload of the row with the largest rank struct."""
    rank_struct = F.struct(*rank)
    if where is not None:
        rank_struct = F.when(where, rank_struct)
    return F.max_by(F.struct(*payload), rank_struct)


def pick_min(payload: Sequence[str], rank: Sequence[Column], where: Column | None = None) -> Column:
    """Aggregate: the payload of the row with the smallest rank struct."""
    rank_struct = F.struct(*rank)
    if where is not None:
        rank_struct = F.when(where, rank_struct)
    return F.min_by(F.struct(*payload), rank_struct)


def ranked_rows(df: DataFrame, keys: Sequence[str], order: Order, rank_col: str = "rn") -> DataFrame:
    """``row_number()`` over each key for every row, without bringing a key into one task.

    Rows are cut into ranges of keys and order, with a hash of the row and its place as the last tie-breaks,
    so a hot key, a hot order value and even one repeated row are spread over many ranges. The ranges are
    written to the shared folder, which fixes them for the two passes that follow: rows are numbered
    inside (key, range), and the counts of the earlier ranges of a key shift the numbers. Without keys
    those counts, one number per range, are put into the plan as a table of constants.
    """
    spark = df.sparkSession
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order_columns(order)]
    ties = [F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns)), F.monotonically_increasing_id()]
    tied = df.withColumns({"_tie_hash": ties[0], "_tie_place": ties[1]})
    parts = tied.repartitionByRange(*by, F.col("_tie_hash"), F.col("_tie_place"))
    path = scratch_path(spark, "ranges")
    parts.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    group = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("_part").alias("part"))
    parts = parts.withColumn("_group", group)
    counts = parts.groupBy("_group").agg(F.count("*").alias("_n"))
    if keys:
        names = [f"_group.k{i}" for i in range(len(keys))]
        earlier = Window.partitionBy(*names).orderBy("_group.part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    else:
        sizes = sorted((r["_group"]["part"], r["_n"]) for r in counts.collect())
        before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
        shifts = [f"({p}, {n}L)" for p, n in before.items()] or ["(0, 0L)"]
        table = spark.sql(f"SELECT * FROM VALUES {', '.join(shifts)} AS t(part, _start)")
        starts = table.select(F.struct(F.col("part")).alias("_group"), "_start")
    local = Window.partitionBy("_group").orderBy(*order_columns(order), "_tie_hash", "_tie_place")
    numbered = parts.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(starts, "_group")
        .withColumn(rank_col, (F.col("_start") + F.col("_local")).cast("bigint"))
        .select(*(F.col(f"`{c}`") for c in df.columns), rank_col)
    )
