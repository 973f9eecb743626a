"""Streaming queries, run over the events table laid out as a log of JSON lines files."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.plans.registry import query
from queryproof.plans.textjobs import CLASS_SQL, CODES, PHASES, reason, reason_sql
from queryproof.sources.jsonl import write_jsonl
from queryproof.streaming import eventlog as log


def event_stream(t, label):
    """The events as a log in shared scratch space: ``(stream, folder)``."""
    folder = t.scratch(label)
    write_jsonl(t.events, f"{folder}/log")
    return log.read_event_log(t.spark, f"{folder}/log", t.events.schema), folder


@query("st_event_log", "SELECT event_id, user_id, event_type, value, props, CAST(ts AS VARCHAR) AS ts FROM events")
def st_event_log(t):
    stream, folder = event_stream(t, "st_event_log")
    log.append_to_table(stream, f"{folder}/table", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/table").withColumn("ts", F.col("ts").cast("string"))


@query(
    "st_latest_state",
    """
SELECT user_id, event_type, n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
  AS rn, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) WHERE rn = 1""",
)
def st_latest_state(t):
    stream, folder = event_stream(t, "st_latest_state")
    state = log.latest_state(stream, "user_id", "event_type", ["ts", "event_id"])
    store = log.UpsertStore(t.spark, f"{folder}/state", ["user_id"], [("latest", "desc")])
    log.run_batches(state, "update", f"{folder}/checkpoint", store.merge)
    return store.current().drop("latest")


@query(
    "st_failure_counts",
    f"""
WITH e AS (SELECT {reason_sql('user_id', PHASES)} AS phase, {reason_sql('event_id', CODES)} AS code FROM events
  WHERE event_type = 'error')
SELECT phase, code, {CLASS_SQL} AS class, count(*) AS n FROM e GROUP BY ALL""",
)
def st_failure_counts(t):
    stream, folder = event_stream(t, "st_failure_counts")
    errors = stream.filter(F.col("event_type") == "error")
    counts = log.failure_counts(errors, reason("user_id", PHASES), reason("event_id", CODES))
    result = log.VersionedResult(t.spark, f"{folder}/result")
    log.run_batches(counts, "complete", f"{folder}/checkpoint", result.write)
    return result.current()


@query(
    "st_keyed_upsert",
    """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
  event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def st_keyed_upsert(t):
    stream, folder = event_stream(t, "st_keyed_upsert")
    store = log.UpsertStore(t.spark, f"{folder}/store", ["user_id"], [("ts", "desc"), ("event_id", "desc")])
    log.run_batches(stream, "append", f"{folder}/checkpoint", store.merge)
    return store.current().select("user_id", "event_id", "event_type", "value")
