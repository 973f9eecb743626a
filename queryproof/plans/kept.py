"""Results that are kept and put together: stored sketches, batches of partials, state and reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.operators.keysketch import SketchStore, parts_for, set_counts
from queryproof.operators.reach import reach_counts
from queryproof.operators.snapshots import SnapshotStore, quantiles
from queryproof.plans.registry import query
from queryproof.plans.reporting import EDGES_SQL, SNAPSHOT_METRICS_SQL, reference_edges, snapshot_metrics
from queryproof.plans.streams import event_stream
from queryproof.plans.textjobs import CLASS_SQL, CODES, PHASES, reason, reason_sql
from queryproof.sources.jsonl import write_jsonl
from queryproof.streaming import eventlog as log


@query(
    "rp_reach_counts",
    f"""
WITH RECURSIVE {EDGES_SQL},
w AS (SELECT fragment AS root, ref, 0 AS level FROM e UNION
      SELECT w.root, e.ref, w.level + 1 FROM w JOIN e ON e.fragment = w.ref WHERE w.level < 60),
c AS (SELECT root, count(DISTINCT ref) AS n_refs, max(CAST(ref = root AS INTEGER)) = 1 AS on_cycle, max(level) = 60 AS degraded FROM w GROUP BY root)
SELECT p_partkey AS root, coalesce(n_refs, 0) AS n_refs, coalesce(on_cycle, false) AS on_cycle, coalesce(degraded, false) AS degraded
FROM part LEFT JOIN c ON root = p_partkey""",
)
def rp_reach_counts(t):
    """References reached and circles, each reference followed once; chains are short enough for exact sketches."""
    return reach_counts(t.part.select(F.col("p_partkey").alias("root")), reference_edges(t), t.scratch("reach"))


_RUN_PAIRS = [("F", "O"), ("O", "P"), ("P", "F"), ("F", "absent")]


@query(
    "so_stored_sets",
    f"""
WITH p AS (SELECT unnest({[a for a, _ in _RUN_PAIRS]}) AS first, unnest({[b for _, b in _RUN_PAIRS]}) AS second),
k AS (SELECT DISTINCT o_orderstatus AS run, o_custkey AS key FROM orders)
SELECT first, second, (SELECT count(*) FROM k WHERE run = first) AS n_first, (SELECT count(*) FROM k WHERE run = second) AS n_second,
  (SELECT count(*) FROM k a JOIN k b USING (key) WHERE a.run = first AND b.run = second) AS n_both,
  (SELECT count(*) FROM k a WHERE a.run = first AND key NOT IN (SELECT key FROM k WHERE run = second)) AS n_only_first,
  (SELECT count(DISTINCT key) FROM k WHERE run IN (first, second)) AS n_either
FROM p""",
)
def so_stored_sets(t):
    """Customers of each order status as stored sketches; a replayed run replaces its sketches. Exact: parts grow with the orders."""
    store = SketchStore(t.spark, t.scratch("key-sketches"), lg=17, parts=parts_for(t.orders.count(), 17))
    store.write(t.orders.filter("o_orderkey % 2 = 0"), "o_orderstatus", "o_custkey")
    store.write(t.orders, "o_orderstatus", "o_custkey")
    return set_counts(store.read(), _RUN_PAIRS, store.lg)


def _stored_snapshots(t):
    """Metrics of all orders in four batches, one of them first written with rows missing and then replayed."""
    store = SnapshotStore(t.spark, t.scratch("snapshots"), ["metric", "code"])
    for batch_id, where in ((2, "o_orderkey % 3 = 0"), *((i, "true") for i in range(4))):
        batch = t.orders.filter(f"o_orderkey % 4 = {batch_id}").filter(where)
        rows = snapshot_metrics(batch, "o_totalprice")
        store.write(rows, batch_id, "o_totalprice")
    return store


_VALUES_SQL = SNAPSHOT_METRICS_SQL.replace("SELECT year(o_orderdate) AS y", "SELECT o_totalprice, o_orderkey, year(o_orderdate) AS y")


@query(
    "rp_snapshot_merged",
    f"""
WITH {_VALUES_SQL}
SELECT metric, code, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 4))) AS DOUBLE) AS total FROM m GROUP BY ALL""",
)
def rp_snapshot_merged(t):
    """The snapshot after all batches, merged from their partials, equals one over all rows."""
    return _stored_snapshots(t).snapshot().select("metric", "code", "n", F.col("total").cast("double").alias("total"))


@query(
    "rp_snapshot_batch_delta",
    f"""
WITH {_VALUES_SQL}
SELECT metric, code, count(*) FILTER (o_orderkey % 4 < 2) AS baseline, count(*) FILTER (o_orderkey % 4 >= 2) AS candidate,
  count(*) FILTER (o_orderkey % 4 >= 2) - count(*) FILTER (o_orderkey % 4 < 2) AS delta FROM m GROUP BY ALL""",
)
def rp_snapshot_batch_delta(t):
    return _stored_snapshots(t).delta([0, 1], [2, 3])


@query(
    "rp_snapshot_quantiles",
    f"""
WITH {_VALUES_SQL}, k AS (SELECT DISTINCT metric, code FROM m)
SELECT metric, code, unnest([0.1, 0.5, 0.9])::DOUBLE AS p, true AS within_error FROM k""",
)
def rp_snapshot_quantiles(t):
    """Quantiles of merged sketches, held against the exact ranks of all rows."""
    found = quantiles(_stored_snapshots(t).snapshot(), ["metric", "code"], [0.1, 0.5, 0.9])
    ranked = snapshot_metrics(t.orders, "o_totalprice").join(found, ["metric", "code"]).groupBy("metric", "code", "p")
    below, up_to = (F.count_if(c) / F.count("*") for c in (F.col("o_totalprice") < F.col("value"), F.col("o_totalprice") <= F.col("value")))
    return ranked.agg(((below - F.col("p") <= 0.02) & (F.col("p") - up_to <= 0.02)).alias("within_error"))


@query(
    "st_state_read",
    f"""
WITH e AS (SELECT {reason_sql('user_id', PHASES)} AS phase, {reason_sql('event_id', CODES)} AS code FROM events
  WHERE event_type = 'error')
SELECT phase, code, {CLASS_SQL} AS class, count(*) AS n FROM e GROUP BY ALL""",
)
def st_state_read(t):
    """The running counts as the state store of the stopped query holds them."""
    stream, folder = event_stream(t, "st_state_read")
    errors = stream.filter(F.col("event_type") == "error")
    counts = log.failure_counts(errors, reason("user_id", PHASES), reason("event_id", CODES))
    log.run_batches(counts, "update", f"{folder}/checkpoint", lambda batch, _: batch.write.format("noop").mode("overwrite").save())
    state = log.stored_state(t.spark, f"{folder}/checkpoint")
    return state.select("key.phase", "key.code", "key.class", F.col("value.count").alias("n"))


_LATE = "event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-15'"


@query(
    "st_expiring_counts",
    f"""
SELECT CAST(time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS window_start, event_type, count(*) AS n
FROM events WHERE NOT ({_LATE}) GROUP BY ALL""",
)
def st_expiring_counts(t):
    """Counts by five days. Rows of the first half that come after the rest are too late for their windows."""
    folder = t.scratch("st_expiring_counts")
    store = log.UpsertStore(t.spark, f"{folder}/store", ["window_start", "event_type"], [("n", "desc")])
    for part in (f"NOT ({_LATE})", _LATE):
        write_jsonl(t.events.filter(part), f"{folder}/log", append=True)
        stream = log.read_event_log(t.spark, f"{folder}/log", t.events.schema)
        timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        counts = log.windowed_counts(timed, "ts", ["event_type"], "5 days", "1 day")
        log.run_batches(counts, "update", f"{folder}/checkpoint", store.merge)
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return store.current().select(start, "event_type", "n")
