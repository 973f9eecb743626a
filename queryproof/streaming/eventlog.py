"""Streaming over the append-only event log.

State is one small row per key; keys are statements, so no watermark expires them. ``windowed_counts`` is
for retention: its state expires by event time. ``stored_state`` reads what a query holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryproof.functions.rules import failure_class
from queryproof.operators.ranking import Order, best_per_key
from queryproof.sources.jsonl import TIMESTAMP_FORMAT


def read_event_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Tail a folder of JSON lines files; new files become new micro-batches."""
    return (
        spark.readStream.schema(schema)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def append_to_table(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Copy everything that has arrived into a parquet table, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_state(stream: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """Latest state per key; partial maxima leave the map tasks, so a hot key costs one row each."""
    newest = F.struct(*order)
    return stream.groupBy(key).agg(
        F.max_by(state, newest).alias(state), F.max(newest).alias("latest"), F.count("*").alias("n_events")
    )


def failure_counts(stream: DataFrame, phase: Column, code: Column) -> DataFrame:
    """Running failure counts by phase, code and class."""
    named = stream.select(phase.alias("phase"), code.alias("code"))
    named = named.withColumn("class", failure_class(F.col("code"), F.col("phase")))
    return named.groupBy("phase", "code", "class").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], width: str, delay: str) -> DataFrame:
    """``(window_start, keys..., n)`` with state that expires.

    The watermark trails the newest event time by ``delay``. A window's counts are dropped from the state
    once it passes the window's end; a row that comes later than that is not counted, however often
    the stream is restarted. Rows within the delay are counted whenever they come.
    """
    timed = stream.withWatermark(ts, delay)
    counts = timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(key, value)`` structs of what a query's checkpoint holds in its state store, after its last batch."""
    return spark.read.format("statestore").load(checkpoint).select("key", "value")


def run_batches(
    stream: DataFrame, mode: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None]
) -> None:
    """Process everything that has arrived, handing each micro-batch to a function."""
    query = (
        stream.writeStream.foreachBatch(on_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class VersionedResult:
    """Result table of a complete-mode query: each batch replaces the one before it.

    Two folders take turns, so only the last two results are kept and a reader of the last one is not
    disturbed while the next is written. Rows carry their batch; the larger number is the current one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/turn={batch_id % 2}")

    def current(self) -> DataFrame:
        table = self.spark.read.option("basePath", self.path).parquet(self.path).drop("turn")
        last = table.agg(F.max("batch")).scalar()
        return table.filter(F.col("batch") == last).drop("batch")


class UpsertStore:
    """Keyed store where the latest row of a key wins.

    A batch is reduced to its latest row per key and written under its batch id. Writing the same
    batch again replaces the same folder, so a replay after a failure changes nothing. Readers take
    the latest row per key over all batches; ``compact`` folds them into one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], latest_first: Order):
        self.spark, self.path = spark, path
        self.keys, self.order = list(keys), list(latest_first)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        latest = best_per_key(batch, self.keys, self.order)
        latest.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self) -> DataFrame:
        table = self.spark.read.option("basePath", self.path).parquet(self.path)
        order = [*self.order, ("batch", "desc")]
        return best_per_key(table, self.keys, order).drop("batch")

    def compact(self, target: str) -> "UpsertStore":
        """Write the current rows as the first batch of a new store and return it."""
        self.current().write.mode("overwrite").parquet(f"{target}/batch=-1")
        return UpsertStore(self.spark, target, self.keys, self.order)
