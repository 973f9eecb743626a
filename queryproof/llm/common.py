"""Shared pieces: written intermediate tables, Arrow batches, distributed numbering and prefix sums."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from queryproof.session import scratch_path


def ship(module: str) -> None:
    """Send this module's functions to executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 512
) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows, which bounds what a worker holds; no shuffle.

    mapInArrow does not find columns with a dot in their name, so ``fn`` sees a dash there.
    """
    if any("." in c for c in df.columns):
        df = df.toDF(*(c.replace(".", "-") for c in df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def worker_memo(name: str, make: Callable[[], object]) -> object:
    """An object kept by a Python worker from task to task, until it is asked for another one."""
    import types

    store = sys.modules.setdefault("_queryproof_worker_memo", types.ModuleType("_queryproof_worker_memo"))
    if getattr(store, "name", None) != name:
        store.held = None
        store.held, store.name = make(), name
    return store.held


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bucket_bits(rows: int, per_bucket: int = 256, most: int = 16) -> int:
    """Bits of a uniform key that make buckets of about ``per_bucket`` rows; 2**most buckets at most."""
    bits = 1
    while bits < most and (per_bucket << bits) < rows:
        bits += 1
    return bits


def totals_before(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier.

    The order is by ``key``, a long of uniformly spread hash values, then by ``ties``. The top bits of
    the key cut every group into ranges, so a hot group is spread over as many tasks as its size asks
    for. Range sums are added up first (2**16 per group at most), then the rows of each range. ``rows``
    is a row count, used for the width of the ranges only. ``group`` must not be null; no tie may be left
    but between rows that agree in ``value``.
    """
    ranges = F.shiftrightunsigned(F.col(key), 64 - bucket_bits(rows))
    df = df.withColumn("_range", ranges)
    sums = df.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(starts, [group, "_range"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )


def ranked(df: DataFrame, order: list[Column], out: str, label: str) -> DataFrame:
    """Number all rows from 0 in the given total order without gathering them in one task.

    Rows are range-partitioned and numbered inside each part; parts start where the earlier ones end.
    What meets in one task is one count per part.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, label)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        parts.join(starts, "_part")
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_part", "_start")
    )


def scalar(df: DataFrame):
    """The single value of a one-row result."""
    return df.first()[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sorted_ranges(df: DataFrame, order: list[Column], out: str = "pos", part: str = "part") -> DataFrame:
    """The rows sorted by ranges of ``order``, with ``out``, a long that rises along it, and ``part``, the range.

    A hot key, and even one repeated row, is spread over many ranges; a part is what one task sorted. Rows
    that agree in ``order`` are numbered as they come, so numbers hold only once the rows are written.
    """
    place = unused(df, "_place")[0]
    tied = df.withColumn(place, F.monotonically_increasing_id())
    order = [*order, F.col(place)]
    ids = F.monotonically_increasing_id()
    parts = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop(place)
    return parts.withColumns({out: ids, part: F.shiftright(ids, 33).cast("int")})


def in_order(df: DataFrame, order: list[Column], label: str, out: str = "pos", part: str = "part") -> DataFrame:
    """``sorted_ranges`` as a written table: what reads the rows again finds the same numbers."""
    return written(sorted_ranges(df, order, out, part), label)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Runs of rows that agree in the first ``keys`` columns, as ``(key, pieces)``, one piece at a time.

    The pieces of a run must be used up before the next run is asked for.
    """
    waiting: list[tuple[tuple, pa.RecordBatch]] = []

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(keys)]
            at = list(zip(*columns, strict=True))
            start = 0
            for i in range(1, len(at) + 1):
                if i == len(at) or at[i] != at[start]:
                    yield at[start], batch.slice(start, i - start)
                    start = i

    source = pieces()

    def run(key: tuple, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield piece
        for other, piece in source:
            if other != key:
                waiting.append((other, piece))
                return
            yield piece

    for first in source:
        waiting.append(first)
        while waiting:
            key, piece = waiting.pop()
            yield key, run(key, piece)


def batched(names: str, types: tuple[pa.DataType, ...], rows: int = 1000) -> Callable:
    """Turn a generator of tuples over Arrow batches into one of Arrow batches of ``rows`` rows."""

    def wrap(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = fn(batches)
            while some := [*islice(found, rows)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types, strict=True)], names=names.split())

        return run

    return wrap


def key_text(column: str) -> Column:
    """A column as text that is never null and differs where the values do."""
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))
