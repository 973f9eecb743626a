"""A partitioned catalog table with an index of its partitions, and table metadata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per file: bounds file size when one partition value holds most rows.
MAX_RECORDS_PER_FILE = 5_000_000


def write_catalog(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per partition value, never one file per key. Large values become many files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(*by).parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog_index(catalog: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Rows and key range of each partition, read from column chunks of two columns only."""
    return catalog.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )


def _exact_metadata(name: str, df: DataFrame, i: int) -> DataFrame:
    """The row of column ``i``, from the counts of its values."""
    f = df.schema.fields[i]
    counts = df.select(F.col(f"`{f.name}`").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    n_rows, n_null = F.sum("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")))
    one = counts.agg(*(F.coalesce(n, F.lit(0)).alias(a) for n, a in ((n_rows, "n_rows"), (n_null, "n_null"))), F.count("v").alias("n_distinct"))
    return one.select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(i + 1).alias("position"),
        F.lit(f.name).alias("column_name"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.lit(f.nullable).alias("nullable"),
        "n_null",
        "n_distinct",
    )


def table_metadata(name: str, df: DataFrame, distinct: str | None = None) -> DataFrame:
    """One row per column: position, type, nullable, rows, NULLs and, if asked, distinct values.

    One aggregation per table; its single row is turned into one row per column. ``distinct`` is
    ``approx`` (a sketch per column, for large tables) or ``exact``: each column is grouped by itself, so
    that a task sends its distinct values once and no row is repeated for every column.
    """
    fields = df.schema.fields
    if distinct == "exact" and fields:
        return reduce(DataFrame.unionAll, [_exact_metadata(name, df, i) for i in range(len(fields))])
    aggregates = [F.count("*").alias("n_rows")]
    for i, f in enumerate(fields):
        col = F.col(f"`{f.name}`")
        aggregates.append(F.count_if(col.isNull()).alias(f"null_{i}"))
        if distinct:
            count = F.count_distinct if distinct == "exact" else F.approx_count_distinct
            aggregates.append(count(col).alias(f"distinct_{i}"))
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            F.col(f"null_{i}").alias("n_null"),
            *([F.col(f"distinct_{i}").alias("n_distinct")] if distinct else []),
        )
        for i, f in enumerate(fields)
    ]
    one = df.agg(*aggregates)
    return one.select(F.lit(name).alias("table_name"), "n_rows", F.inline(F.array(*rows)))
