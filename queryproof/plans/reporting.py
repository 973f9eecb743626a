"""Consensus and run reports.

Bindings: line items are the variants of an order (statement), orders are acceptance rows of a
customer (run), events are the log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.functions import reports, rules
from queryproof.functions.rules import first_match
from queryproof.operators import consensus as cons
from queryproof.operators.counting import fixed_status_counts, share
from queryproof.operators.closure import reference_closure
from queryproof.operators.joins import exists_in, not_exists_in
from queryproof.operators.lookup import enrich
from queryproof.plans.registry import query
from queryproof.plans.textjobs import CODES, counted, reason, reason_sql

POSITION = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _null():
    return F.lit(None).cast("string")


def variants(t, *extra):
    """Line items as variants: mostly passing, with some of every kind of disagreement."""
    qty, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    status = first_match([(qty == 50, "FAIL"), (qty == 49, "NEED_MORE_PARAMS")], "PASS")
    gate = first_match([(qty == 48, "UNCERTAIN"), (qty == 47, "BLOCKED")], "PASS")
    return t.lineitem.select(
        "l_orderkey",
        *POSITION,
        status.alias("status"),
        gate.alias("gate"),
        F.when(F.col("l_linenumber") != 7, F.when(disc > 0.095, "WRAPPER").otherwise("ALIAS")).alias("family"),
        F.when(tax > 0.01, F.when(tax > 0.075, "BODY").otherwise("STATEMENT")).alias("surface"),
        F.when(disc < 0.085, F.when(tax > 0.065, "replace:where").otherwise("replace:select")).alias("ops"),
        F.when(F.col("l_linenumber") < 6, F.concat_ws("-", *POSITION)).alias("candidate"),
        (F.col("l_orderkey") % 17 != 0).alias("supported"),
        F.when((status != "PASS") & (tax > 0.03), F.concat(F.lit("VALIDATE_"), "l_linestatus")).alias("status_reason"),
        F.when(tax > 0.03, F.concat(F.lit("SEMANTIC_"), "l_returnflag")).alias("gate_reason"),
        F.when(F.col("l_linenumber") != 2, F.col("l_partkey") % 41 == 3).alias("at_risk"),
        first_match([(F.col("l_suppkey") % 11 == 5, "MULTI_FRAGMENT_INCLUDE"), (F.col("l_orderkey") % 3 == 1, "FOREACH_COLLECTION_PREDICATE")], _null()).alias("shape"),
        F.when(F.col("l_suppkey") % 29 == 4, "MULTI_FRAGMENT_INCLUDE_REVIEW_ONLY").alias("blocker"),
        F.when(tax > 0.05, "REVIEW_REQUIRED").alias("tier"),
        *extra,
    )


VARIANTS_SQL = """
v AS (SELECT *, CASE WHEN l_quantity = 50 THEN 'FAIL' WHEN l_quantity = 49 THEN 'NEED_MORE_PARAMS' ELSE 'PASS' END AS status,
  CASE WHEN l_quantity = 48 THEN 'UNCERTAIN' WHEN l_quantity = 47 THEN 'BLOCKED' ELSE 'PASS' END AS gate,
  CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_discount > 0.095 THEN 'WRAPPER' ELSE 'ALIAS' END END AS family,
  CASE WHEN l_tax > 0.01 THEN CASE WHEN l_tax > 0.075 THEN 'BODY' ELSE 'STATEMENT' END END AS surface,
  CASE WHEN l_discount < 0.085 THEN CASE WHEN l_tax > 0.065 THEN 'replace:where' ELSE 'replace:select' END END AS ops,
  CASE WHEN l_linenumber < 6 THEN 1 END AS candidate,
  CASE WHEN l_quantity >= 49 AND l_tax > 0.03 THEN 'VALIDATE_' || l_linestatus END AS status_reason,
  CASE WHEN l_tax > 0.03 THEN 'SEMANTIC_' || l_returnflag END AS gate_reason FROM lineitem)"""
CONSENSUS_SQL = f"""{VARIANTS_SQL},
g AS (SELECT l_orderkey, count(*) AS n_variants, count(*) FILTER (status = 'PASS') AS n_pass,
  count(*) FILTER (status = 'NEED_MORE_PARAMS') AS n_partial, count(*) FILTER (status = 'FAIL') AS n_fail,
  count(*) FILTER (gate = 'PASS') AS n_gate_pass, count(*) FILTER (gate = 'BLOCKED') AS n_gate_blocked,
  count(*) FILTER (gate = 'UNCERTAIN') AS n_gate_uncertain, count(candidate) AS nc, count(DISTINCT family) AS nf,
  coalesce(bool_or(l_linenumber <> 2 AND l_partkey % 41 = 3), false) AS risky, bool_or(l_suppkey % 11 = 5 OR l_suppkey % 29 = 4) AS fragments,
  bool_or(l_suppkey % 11 <> 5 AND l_orderkey % 3 = 1) AND bool_or(l_tax > 0.05) AS collection,
  count(DISTINCT surface) AS ns, count(DISTINCT ops) AS no, min(family) AS f, min(surface) AS s, min(ops) AS o,
  first(status_reason ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (status_reason IS NOT NULL) AS sr,
  first(gate_reason ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (gate <> 'PASS' AND gate_reason IS NOT NULL) AS gr
  FROM v GROUP BY l_orderkey),
r AS (SELECT *, CASE WHEN l_orderkey % 17 = 0 THEN 'SHAPE_FAMILY_NOT_TARGET'
  WHEN n_pass < n_variants THEN coalesce(sr, 'VALIDATE_STATUS_NOT_PASS')
  WHEN n_gate_pass < n_variants THEN coalesce(gr, 'SEMANTIC_GATE_NOT_PASS')
  WHEN nf = 0 AND nc = 0 THEN 'NO_PATCHABLE_CANDIDATE_SELECTED' WHEN nf = 0 THEN 'NO_PATCHABLE_CANDIDATE_UNSUPPORTED_STRATEGY'
  WHEN nf > 1 THEN 'PATCH_FAMILY_CONFLICT_OR_MISSING' WHEN ns > 1 THEN 'PATCH_SURFACE_CONFLICT'
  WHEN no > 1 THEN 'REWRITE_OPS_CONFLICT' WHEN risky THEN 'SEMANTIC_RISK_TAIL_BLOCKED'
  WHEN fragments THEN 'NO_SAFE_BASELINE_MULTI_FRAGMENT_INCLUDE'
  WHEN collection THEN 'NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE' END AS conflict_reason FROM g),
d AS (SELECT l_orderkey, n_variants, n_pass, n_partial, n_fail, n_gate_pass, n_gate_blocked, n_gate_uncertain,
  CASE WHEN conflict_reason IS NULL THEN 'AUTO_PATCHABLE' ELSE 'MANUAL_REVIEW' END AS decision, conflict_reason,
  CASE WHEN conflict_reason IS NULL THEN f END AS family, CASE WHEN conflict_reason IS NULL THEN s END AS surface,
  CASE WHEN conflict_reason IS NULL THEN o END AS ops FROM r)"""


def decisions(t):
    return cons.consensus(variants(t), "l_orderkey", POSITION)


@query("rp_consensus", f"WITH {CONSENSUS_SQL} SELECT * FROM d")
def rp_consensus(t):
    return decisions(t)


@query(
    "rp_ops_fingerprint",
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string(list_sort(list_filter([
  CASE WHEN l_returnflag <> 'A' THEN l_returnflag || ':' || l_linenumber END, l_linestatus || ':' || l_suppkey,
  CASE WHEN l_tax > 0.04 THEN 'tax:' END], lambda x: x IS NOT NULL)), '|') AS ops FROM lineitem""",
)
def rp_ops_fingerprint(t):
    def op(name, target):
        return F.struct(name.alias("op"), target.cast("string").alias("target"))

    ops = F.array(
        op(F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")), F.col("l_linenumber")),
        op(F.col("l_linestatus"), F.col("l_suppkey")),
        op(F.when(F.col("l_tax") > 0.04, F.lit("tax")).otherwise(""), _null()),
    )
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cons.ops_fingerprint(ops).alias("ops"))


@query(
    "rp_first_conflict",
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity > 40 THEN 'FAIL' ELSE 'PASS' END AS gate,
  CASE WHEN l_tax > 0.07 THEN 'HARD_CONFLICT_X' WHEN l_returnflag = 'N' THEN 'SEMANTIC_PREDICATE_CHANGED'
       WHEN l_linestatus = 'F' AND l_discount > 0.02 THEN 'SEMANTIC_ORDERING_CHANGED'
       WHEN l_linenumber = 4 THEN 'SEMANTIC_ROW_COUNT_UNVERIFIED' END AS reason FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY reason IS NULL, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM r WHERE gate <> 'PASS')
SELECT l_orderkey, coalesce(reason, 'SEMANTIC_GATE_NOT_PASS') AS conflict FROM x WHERE rn = 1""",
)
def rp_first_conflict(t):
    checks = [
        (F.lit("UNCERTAIN"), F.when(F.col("l_returnflag") == "N", "SEMANTIC_PREDICATE_CHANGED").otherwise("SEMANTIC_PREDICATE_STABLE")),
        (F.lit("PASS"), F.lit("SEMANTIC_PROJECTION_CHANGED")),
        (F.when(F.col("l_linestatus") == "F", "FAIL").otherwise("PASS"),
         F.when(F.col("l_discount") > 0.02, "SEMANTIC_ORDERING_CHANGED").otherwise("")),
    ]
    hard = rules.matching_codes([(F.col("l_tax") > 0.07, "HARD_CONFLICT_X")])
    others = F.array(
        F.lit("SEMANTIC_PAGINATION_STABLE"),
        F.when(F.col("l_linenumber") == 4, "SEMANTIC_ROW_COUNT_UNVERIFIED").otherwise(""),
    )
    rows = t.lineitem.select(
        "l_orderkey", *POSITION,
        F.when(F.col("l_quantity") > 40, "FAIL").otherwise("PASS").alias("gate"),
        cons.conflict_of_row(hard, checks, others).alias("reason"),
    )
    return cons.first_conflict(rows, "l_orderkey", POSITION)


@query(
    "rp_sql_rows",
    f"""
WITH {VARIANTS_SQL},
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC,
  l_suppkey DESC, l_extendedprice DESC) AS rn FROM v) WHERE rn = 1),
w AS (SELECT o_orderkey, coalesce(status, 'PENDING') AS status, coalesce(gate, 'UNKNOWN') AS gate_status,
  CASE WHEN l_tax IS NULL THEN 'UNKNOWN' WHEN l_tax > 0.05 THEN 'HIGH' WHEN l_tax > 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  coalesce(c_mktsegment = 'BUILDING', false) AS patch_applicable, l_extendedprice AS before_cost, status_reason,
  l_returnflag, l_orderkey FROM orders LEFT JOIN a ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) c ON c_custkey = o_custkey)
SELECT o_orderkey, status, gate_status, confidence, patch_applicable, before_cost,
  CASE WHEN gate_status <> 'PASS' THEN 'SEMANTIC_GATE_' || gate_status WHEN confidence = 'LOW' THEN
    'VALIDATE_SEMANTIC_CONFIDENCE_LOW' WHEN status <> 'PASS' THEN coalesce(status_reason, status) END AS blocked_reason,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN status = 'FAIL' THEN 'HARD_CONFLICT:' || status
    WHEN confidence IN ('MEDIUM', 'HIGH') THEN 'ALREADY_CONFIDENT' WHEN l_returnflag IS NULL THEN 'DB_EVIDENCE_MISSING'
    ELSE 'UPGRADE_NOT_NEEDED' END AS not_upgraded_reason FROM w""",
)
def rp_sql_rows(t):
    """One wide row per statement: latest acceptance row, patch row of its group, reasons."""
    accepted = variants(t, "l_tax", "l_returnflag")
    latest = [(p, "desc") for p in POSITION]
    rows = enrich(
        t.orders.select("o_orderkey", "o_custkey"), accepted, "o_orderkey", "l_orderkey", latest,
        ["status", "gate", "status_reason", "l_tax", "l_extendedprice", "l_returnflag"],
    )
    patches = t.customer.filter("c_nationkey < 20")
    rows = enrich(rows, patches, "o_custkey", "c_custkey", [("c_custkey", "desc")], ["c_mktsegment"])
    confidence = first_match(
        [(F.col("l_tax").isNull(), "UNKNOWN"), (F.col("l_tax") > 0.05, "HIGH"), (F.col("l_tax") > 0.02, "MEDIUM")], "LOW"
    )
    rows = rows.select(
        "o_orderkey",
        F.coalesce("status", F.lit("PENDING")).alias("status"),
        F.coalesce("gate", F.lit("UNKNOWN")).alias("gate_status"),
        confidence.alias("confidence"),
        F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)).alias("patch_applicable"),
        F.col("l_extendedprice").alias("before_cost"),
        "status_reason",
        "l_returnflag",
    )
    blocked = reports.gate_blocked_reason(F.col("gate_status"), F.col("confidence"), F.col("status"), F.col("status_reason"))
    upgrade = reports.not_upgraded_reason(
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)),
        F.when(F.col("status") == "FAIL", F.col("status")),
        F.col("confidence"),
        F.when(F.col("l_returnflag").isNull(), "NONE").otherwise("EXACT"),
        F.when(F.col("l_returnflag").isNull(), "SKIPPED").otherwise("MATCH"),
    )
    return rows.withColumns({"blocked_reason": blocked, "not_upgraded_reason": upgrade}).drop("status_reason", "l_returnflag")


RUN_SQL = """
u AS (SELECT c_custkey, count(o_orderkey) AS n_units, count(*) FILTER (o_totalprice > 490000) AS n_fatal,
  count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000) AS n_fail,
  count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 300000) AS n_need_params,
  count(*) FILTER (o_orderstatus = 'F') AS n_ready,
  count(*) FILTER (o_orderpriority = '5-LOW') AS n_warnings, count(*) FILTER (o_orderstatus = 'O') AS n_blocked,
  count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P') AS n_incomplete
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""


def runs(t):
    """Counters per run; orders are counted first, runs without orders count zero."""
    status, price, priority = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    counts = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_units"),
        F.count_if(price > 490000).alias("n_fatal"),
        F.count_if((status == "O") & (price > 400000)).alias("n_fail"),
        F.count_if((status == "P") & (price > 300000)).alias("n_need_params"),
        F.count_if(status == "F").alias("n_ready"),
        F.count_if(priority == "5-LOW").alias("n_warnings"),
        F.count_if(status == "O").alias("n_blocked"),
        F.count_if((priority == "4-NOT SPECIFIED") & (status == "P")).alias("n_incomplete"),
    )
    joined = t.customer.select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return joined.fillna(0)


@query(
    "rp_verdict",
    f"""
WITH {RUN_SQL} SELECT c_custkey, CASE WHEN n_fatal > 0 THEN 'BLOCKED' WHEN n_fail > 0 THEN 'ATTENTION'
  WHEN n_need_params > 0 THEN 'PARTIAL' WHEN n_units = 0 THEN 'EMPTY' ELSE 'PASS' END AS verdict FROM u""",
)
def rp_verdict(t):
    verdict = reports.run_verdict(*[F.col(c) for c in ("n_units", "n_fatal", "n_fail", "n_need_params")])
    return runs(t).select("c_custkey", verdict.alias("verdict"))


@query(
    "rp_next_action",
    f"""
WITH {RUN_SQL} SELECT CASE WHEN n_incomplete > 0 AND n_units % 2 = 0 THEN 'resume' WHEN n_warnings > 0 THEN 'inspect'
  WHEN n_ready > 0 AND n_blocked = 0 THEN 'apply' ELSE 'inspect' END AS next_action, count(*) AS n FROM u GROUP BY ALL""",
)
def rp_next_action(t):
    action = reports.next_action(
        F.col("n_incomplete"), F.col("n_units") % 2 == 1, F.col("n_warnings"), F.col("n_ready"), F.col("n_blocked")
    )
    return counted(runs(t).withColumn("next_action", action), "next_action")


FAILURES_SQL = f"""
a AS (SELECT o_orderkey AS key, 'validate' AS phase, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 400000
    THEN 'VALIDATE_SEMANTIC_GATE_NOT_PASS' WHEN o_totalprice > 300000 THEN 'VALIDATE_SEMANTIC_CONFIDENCE_LOW' END
    ELSE coalesce(nullif(nullif({reason_sql('o_custkey', CODES)}, 'NEW_CODE'), 'SCAN_MAPPER_NOT_FOUND'), 'VALIDATE_PARAM_INSUFFICIENT') END AS code,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus WHEN o_totalprice > 400000 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders),
e AS (SELECT event_id AS key, CASE user_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'optimize' ELSE 'patch_generate' END AS phase,
    coalesce(nullif({reason_sql('event_id', CODES)}, 'NEW_CODE'), 'RUNTIME_RETRY_EXHAUSTED') AS code, 'FAILED' AS status
    FROM events WHERE event_type = 'error'),
x AS (SELECT * FROM a WHERE code IS NOT NULL UNION ALL SELECT * FROM e)"""


def failures(t):
    """Failures of both sources with their class; passing rows fail only through their gate."""
    code = reason("o_custkey", CODES)
    price = F.col("o_totalprice")
    passed = F.col("o_orderstatus") == "F"
    gate_code = F.when(price > 400000, "VALIDATE_SEMANTIC_GATE_NOT_PASS").when(price > 300000, "VALIDATE_SEMANTIC_CONFIDENCE_LOW")
    known = F.when(~code.isin("NEW_CODE", "SCAN_MAPPER_NOT_FOUND"), code)
    acceptance = t.orders.select(
        F.col("o_orderkey").alias("key"),
        F.lit("validate").alias("phase"),
        F.when(passed, gate_code).otherwise(F.coalesce(known, F.lit("VALIDATE_PARAM_INSUFFICIENT"))).alias("code"),
        F.when(~passed, F.col("o_orderstatus")).when(price > 400000, "FAIL").otherwise("PASS").alias("status"),
    ).filter(F.col("code").isNotNull())
    stage = F.element_at(F.array(F.lit("scan"), F.lit("optimize"), F.lit("patch_generate")), (F.col("user_id") % 3).cast("int") + 1)
    log_code = reason("event_id", CODES)
    log = t.events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("key"),
        stage.alias("phase"),
        F.coalesce(F.when(log_code != "NEW_CODE", log_code), F.lit("RUNTIME_RETRY_EXHAUSTED")).alias("code"),
        F.lit("FAILED").alias("status"),
    )
    both = acceptance.unionByName(log)
    return both.withColumn("class", rules.failure_class(F.col("code"), F.col("phase")))


_CLASS_SQL = """CASE WHEN code IN ('VALIDATE_TIMEOUT', 'PATCH_GENERATION_ERROR', 'RUNTIME_STAGE_TIMEOUT', 'RUNTIME_RETRY_EXHAUSTED')
  THEN 'retryable' WHEN code IN ('SCAN_MAPPER_NOT_FOUND', 'PREFLIGHT_CHECK_FAILED') THEN 'fatal' ELSE 'degradable' END"""


@query("rp_failure_table", f"WITH {FAILURES_SQL} SELECT key, phase, code, status, {_CLASS_SQL} AS class FROM x")
def rp_failure_table(t):
    return failures(t)


@query(
    "rp_failure_counts",
    f"""
WITH {FAILURES_SQL}, c AS (SELECT phase, code, {_CLASS_SQL} AS class FROM x)
SELECT CASE WHEN grouping(phase) = 0 THEN 'phase_code' WHEN grouping(code) = 0 THEN 'code' ELSE 'class' END AS metric,
  phase, code, class, count(*) AS n FROM c GROUP BY GROUPING SETS ((phase, code), (code), (class))""",
)
def rp_failure_counts(t):
    """Counts by phase and code, by code and by class in one shuffle."""
    sets = failures(t).groupingSets([["phase", "code"], ["code"], ["class"]], "phase", "code", "class")
    metric = F.when(F.grouping("phase") == 0, "phase_code").when(F.grouping("code") == 0, "code").otherwise("class")
    return sets.agg(F.count("*").alias("n"), metric.alias("metric"))


@query(
    "rp_verification_gate",
    """
WITH p AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'),
uv AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
ap AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
up AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_tax > 0.075),
c AS (SELECT (SELECT count(*) FROM p WHERE k IN (SELECT k FROM uv)) AS n_unverified_pass,
  (SELECT count(*) FROM ap WHERE k IN (SELECT k FROM up)) AS n_unverified_applicable,
  (SELECT count(*) FROM ((SELECT k FROM p WHERE k IN (SELECT k FROM uv)) UNION (SELECT k FROM ap WHERE k IN (SELECT k FROM up)))) AS n_critical_keys,
  (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS n_partial)
SELECT n_unverified_pass, n_unverified_applicable, n_critical_keys, concat_ws(',', CASE WHEN n_unverified_pass > 0 THEN
  'UNVERIFIED_PASS_ACCEPTANCE' END, CASE WHEN n_unverified_applicable > 0 THEN 'UNVERIFIED_APPLICABLE_PATCH' END) AS warnings,
  CASE WHEN n_unverified_pass + n_unverified_applicable > 0 THEN 'LOW' WHEN n_partial > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM c""",
)
def rp_verification_gate(t):
    """Flags per key from both sources meet in one aggregation by key; the gate counts the flags."""
    o = t.orders.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_orderstatus") == "F").alias("passed"),
        (F.col("o_orderpriority") == "1-URGENT").alias("applicable"),
        *[F.lit(False).alias(n) for n in ("unverified", "unverified_patch", "partial")],
    )
    li = t.lineitem.select(
        F.col("l_orderkey").alias("k"),
        F.lit(False).alias("passed"),
        F.lit(False).alias("applicable"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("unverified"),
        ((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.075)).alias("unverified_patch"),
        (F.col("l_linestatus") == "O").alias("partial"),
    )
    flags = ["passed", "applicable", "unverified", "unverified_patch", "partial"]
    keyed = o.unionByName(li).groupBy("k").agg(*[F.bool_or(f).alias(f) for f in flags])
    bad_pass = F.col("passed") & F.col("unverified")
    bad_patch = F.col("applicable") & F.col("unverified_patch")
    c = keyed.agg(
        F.count_if(bad_pass).alias("n_unverified_pass"),
        F.count_if(bad_patch).alias("n_unverified_applicable"),
        F.count_if(bad_pass | bad_patch).alias("n_critical_keys"),
        F.count_if("partial").alias("_partial"),
    )
    warnings = rules.matching_codes(
        [
            (F.col("n_unverified_pass") > 0, "UNVERIFIED_PASS_ACCEPTANCE"),
            (F.col("n_unverified_applicable") > 0, "UNVERIFIED_APPLICABLE_PATCH"),
        ]
    )
    confidence = F.when(F.size(warnings) > 0, "LOW").when(F.col("_partial") > 0, "MEDIUM").otherwise("HIGH")
    return c.select(
        "n_unverified_pass", "n_unverified_applicable", "n_critical_keys",
        F.array_join(warnings, ",").alias("warnings"), confidence.alias("confidence"),
    )


@query(
    "rp_phase_coverage",
    """
SELECT event_type AS phase, count(*) AS recorded, (SELECT count(*) FROM customer) AS expected,
  CASE WHEN (SELECT count(*) FROM customer) > 0 THEN round(count(*) / (SELECT count(*) FROM customer), 3) ELSE 1.0 END AS ratio
FROM events GROUP BY event_type""",
)
def rp_phase_coverage(t):
    expected = t.customer.agg(F.count("*")).scalar()
    counts = t.events.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("recorded"))
    counts = counts.withColumn("expected", expected)
    ratio = F.when(F.col("expected") > 0, F.round(F.col("recorded") / F.col("expected"), 3)).otherwise(1.0)
    return counts.withColumn("ratio", ratio)


@query("rp_blocking_keys", "SELECT DISTINCT user_id AS blocking_key FROM events WHERE event_type = 'error' AND value > 5")
def rp_blocking_keys(t):
    return (
        t.events.filter((F.col("event_type") == "error") & (F.col("value") > 5))
        .select(F.col("user_id").alias("blocking_key"))
        .distinct()
        .orderBy("blocking_key")
    )


@query(
    "rp_evidence_state",
    """
WITH e AS (SELECT user_id, count(*) AS n, bool_or(event_type = 'error' AND value > 40) AS gap,
  bool_or(event_type = 'view' AND value > 40) AS degraded FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN gap THEN 'CRITICAL_GAP' WHEN degraded THEN 'DEGRADED' WHEN n > 0 THEN 'COMPLETE' ELSE 'NONE' END AS state
FROM customer LEFT JOIN e ON user_id = c_custkey""",
)
def rp_evidence_state(t):
    high = F.col("value") > 40
    e = t.events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.bool_or((F.col("event_type") == "error") & high).alias("gap"),
        F.bool_or((F.col("event_type") == "view") & high).alias("degraded"),
    )
    joined = t.customer.select("c_custkey").join(e, F.col("c_custkey") == F.col("user_id"), "left")
    state = reports.evidence_state(F.col("n"), F.col("gap"), F.col("degraded"))
    return joined.select("c_custkey", state.alias("state"))


@query(
    "rp_confidence_upgrades",
    """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase'),
s AS (SELECT event_id, unnest(CASE WHEN k % 4 = 0 THEN ['UNKNOWN'] WHEN k % 4 = 1 THEN ['DB_FINGERPRINT'] WHEN k % 4 = 2
  THEN ['DB_COUNT', 'STRUCTURE'] ELSE ['DB_FINGERPRINT'] END) AS source FROM e)
SELECT source, count(*) AS n_rows FROM s GROUP BY source UNION ALL SELECT 'UPGRADED', count(*) FROM e""",
)
def rp_confidence_upgrades(t):
    """Upgraded rows and their distinct sources; rows that name none fall back to their reasons."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    listed = first_match(
        [
            (k == 2, F.array(F.lit("db_count"), F.lit(" STRUCTURE "), F.lit("DB_COUNT"))),
            (k == 3, F.array(F.lit("DB_FINGERPRINT"), F.lit(""))),
        ],
        F.array().cast("array<string>"),
    )
    reasons = F.when(k == 1, F.array(F.lit("UPGRADE_DB_FINGERPRINT_EXACT"))).otherwise(F.array().cast("array<string>"))
    sources = F.array_distinct(F.filter(F.transform(listed, lambda s: F.upper(F.trim(s))), lambda s: s != ""))
    inferred = F.when(F.exists(reasons, lambda r: F.contains(r, F.lit("DB_FINGERPRINT"))), "DB_FINGERPRINT").otherwise("UNKNOWN")
    final = F.when(F.size(sources) == 0, F.array(inferred)).otherwise(sources)
    upgraded = t.events.filter(F.col("event_type") == "purchase")
    codes = upgraded.select(F.explode(F.array_append(final, F.lit("UPGRADED"))).alias("source"))
    return codes.groupBy("source").agg(F.count("*").alias("n_rows"))


@query(
    "rp_progress",
    """
WITH s AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer
  WHERE c_mktsegment = 'BUILDING'))
SELECT count(*) AS n_statements, count(*) FILTER (o_orderstatus = 'F') AS n_auto, count(*) FILTER (o_orderstatus = 'O') AS n_review,
  count(*) FILTER (o_orderstatus = 'P') AS n_not_patchable, count(*) - count(*) FILTER (o_orderstatus = 'F') AS n_blocked,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) ELSE 0.0 END AS auto_rate FROM s""",
)
def rp_progress(t):
    keys = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    chosen = exists_in(t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), "o_custkey", keys, "c_custkey")
    status = F.col("o_orderstatus")
    n, auto = F.count("*"), F.count_if(status == "F")
    return chosen.agg(
        n.alias("n_statements"),
        auto.alias("n_auto"),
        F.count_if(status == "O").alias("n_review"),
        F.count_if(status == "P").alias("n_not_patchable"),
        (n - auto).alias("n_blocked"),
        share(auto, n, 4).alias("auto_rate"),
    )


SNAPSHOT_METRICS_SQL = """
m AS (SELECT year(o_orderdate) AS y, unnest([{'metric': 'status', 'code': o_orderstatus}, {'metric': 'priority', 'code': o_orderpriority},
  {'metric': 'total', 'code': ''}, {'metric': 'expensive', 'code': CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END}],
  recursive := true) FROM orders)"""


def snapshot_metrics(orders, *extra):
    """Every order as the metrics it counts for: ``(extra..., y, metric, code)``."""

    def metric(name, code):
        return F.struct(F.lit(name).alias("metric"), code.alias("code"))

    expensive = F.when(F.col("o_totalprice") > 250000, "yes").otherwise("no")
    return orders.select(
        *extra,
        F.year("o_orderdate").alias("y"),
        F.inline(
            F.array(
                metric("status", F.col("o_orderstatus")),
                metric("priority", F.col("o_orderpriority")),
                metric("total", F.lit("")),
                metric("expensive", expensive),
            )
        ),
    )


@query("rp_snapshot", f"WITH {SNAPSHOT_METRICS_SQL} SELECT metric, code, count(*) AS n FROM m WHERE y = 1997 GROUP BY ALL")
def rp_snapshot(t):
    return counted(snapshot_metrics(t.orders).filter("y = 1997"), "metric", "code")


@query(
    "rp_snapshot_delta",
    f"""
WITH {SNAPSHOT_METRICS_SQL} SELECT metric, code, count(*) FILTER (y = 1997) AS baseline, count(*) FILTER (y = 1998) AS candidate,
  count(*) FILTER (y = 1998) - count(*) FILTER (y = 1997) AS delta FROM m WHERE y IN (1997, 1998) GROUP BY ALL""",
)
def rp_snapshot_delta(t):
    """Both snapshots in one aggregation, so that a key missing on one side simply counts zero."""
    both = snapshot_metrics(t.orders).filter("y IN (1997, 1998)")
    base, cand = F.count_if(F.col("y") == 1997), F.count_if(F.col("y") == 1998)
    return both.groupBy("metric", "code").agg(
        base.alias("baseline"), cand.alias("candidate"), (cand - base).alias("delta")
    )


@query(
    "rp_regressions",
    """
SELECT count(*) FILTER (c_mktsegment = 'BUILDING' AND o_orderstatus <> 'F') AS ready_regressions,
  count(*) FILTER (c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F') AS blocked_boundary_regressions
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def rp_regressions(t):
    sentinels = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    joined = t.orders.select("o_custkey", "o_orderstatus").join(sentinels, F.col("o_custkey") == F.col("c_custkey"))
    ready = F.col("c_mktsegment") == "BUILDING"
    auto = F.col("o_orderstatus") == "F"
    return joined.agg(
        F.count_if(ready & ~auto).alias("ready_regressions"),
        F.count_if(~ready & auto).alias("blocked_boundary_regressions"),
    )


BUCKET_SQL = f"""
k AS (SELECT o_orderpriority, upper({reason_sql('o_custkey')}) AS code, o_orderstatus FROM orders),
b AS (SELECT o_orderpriority, CASE WHEN starts_with(code, 'NO_PATCHABLE_CANDIDATE') THEN 'NO_PATCHABLE_CANDIDATE_SELECTED'
  WHEN starts_with(code, 'NO_SAFE_BASELINE_') THEN 'NO_SAFE_BASELINE_RECOVERY' WHEN starts_with(code, 'SEMANTIC_')
  THEN 'SEMANTIC_GATE_NOT_PASS' WHEN starts_with(code, 'VALIDATE_') THEN 'VALIDATE_STATUS_NOT_PASS'
  WHEN code = 'SHAPE_FAMILY_NOT_TARGET' THEN code ELSE 'OTHER' END AS bucket FROM k
  WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW')"""


@query(
    "rp_decision_focus",
    f"""
WITH {BUCKET_SQL},
n AS (SELECT o_orderpriority, bucket, count(*) AS n, list_position({list(rules.BLOCKER_BUCKETS)}, bucket) AS pos FROM b GROUP BY ALL),
w AS (SELECT o_orderpriority, bucket FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, pos) AS rn FROM n) WHERE rn = 1),
f AS (SELECT p.o_orderpriority AS batch, coalesce(bucket, 'READY') AS decision_focus FROM (SELECT DISTINCT o_orderpriority FROM orders) p
  LEFT JOIN w USING (o_orderpriority))
SELECT batch, decision_focus, CASE decision_focus WHEN 'NO_PATCHABLE_CANDIDATE_SELECTED' THEN 'fix_shared_candidate_selection_gaps'
  WHEN 'NO_SAFE_BASELINE_RECOVERY' THEN 'clarify_safe_baseline_recovery_paths' WHEN 'SEMANTIC_GATE_NOT_PASS' THEN
  'fix_semantic_comparison_weaknesses' WHEN 'VALIDATE_STATUS_NOT_PASS' THEN 'fix_validation_status_propagation'
  WHEN 'SHAPE_FAMILY_NOT_TARGET' THEN 'curate_family_boundary_candidates' WHEN 'OTHER' THEN 'inspect_misc_blockers'
  ELSE 'expand_generalization_coverage' END AS next_step FROM f""",
)
def rp_decision_focus(t):
    """Largest blocker bucket of each batch, the earlier bucket on ties; READY without blockers."""
    blocked = (F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") != "5-LOW")
    bucket = F.when(blocked, rules.blocker_bucket(reason("o_custkey")))
    counts = t.orders.groupBy("o_orderpriority", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    position = F.array_position(F.array(*[F.lit(b) for b in rules.BLOCKER_BUCKETS]), F.col("bucket"))
    focus = F.max_by("bucket", F.when(F.col("bucket").isNotNull(), F.struct(F.col("n"), -position)))
    out = counts.groupBy(F.col("o_orderpriority").alias("batch")).agg(F.coalesce(focus, F.lit("READY")).alias("decision_focus"))
    return out.withColumn("next_step", rules.NEXT_STEP.lookup(F.col("decision_focus")))


@query(
    "rp_auto_rate_gate",
    """
SELECT o_custkey, count(*) AS n_statements, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS auto_rate,
  count(*) FILTER (o_orderstatus = 'F') / count(*) >= 0.4 AS gate_passed FROM orders GROUP BY o_custkey""",
)
def rp_auto_rate_gate(t):
    n, auto = F.count("*"), F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(
        n.alias("n_statements"), share(auto, n, 4).alias("auto_rate"), ((n > 0) & (auto / n >= 0.4)).alias("gate_passed")
    )


@query(
    "rp_select_keys",
    """
WITH units AS (SELECT concat(l_orderkey, '#v', l_linenumber) AS k, CAST(l_orderkey AS VARCHAR) AS s FROM lineitem),
ex AS (SELECT DISTINCT k FROM units), one AS (SELECT s, min(k) AS k FROM units GROUP BY s HAVING count(*) = 1),
req AS (SELECT concat(o_orderkey, '#v', o_custkey % 5 + 1) AS k, CAST(o_orderkey AS VARCHAR) AS s FROM orders)
SELECT req.k AS requested, coalesce(ex.k, one.k) AS resolved, CASE WHEN ex.k IS NOT NULL THEN 'EXACT' WHEN one.k IS NOT NULL
  THEN 'STATEMENT' ELSE 'MISSING' END AS how FROM req LEFT JOIN ex ON ex.k = req.k LEFT JOIN one ON one.s = req.s""",
)
def rp_select_keys(t):
    """Requested keys resolved exactly, else through the only variant of their statement, else missing."""
    units = t.lineitem.select(
        F.concat("l_orderkey", F.lit("#v"), "l_linenumber").alias("unit"), F.col("l_orderkey").cast("string").alias("statement")
    )
    exact = units.select("unit").distinct()
    single = units.groupBy("statement").agg(F.count("*").alias("n"), F.min("unit").alias("only_unit")).filter("n = 1")
    requested = t.orders.select(
        F.concat("o_orderkey", F.lit("#v"), (F.col("o_custkey") % 5 + 1)).alias("requested"),
        F.col("o_orderkey").cast("string").alias("statement"),
    )
    joined = requested.join(exact, F.col("requested") == F.col("unit"), "left").join(
        single.select("statement", "only_unit"), "statement", "left"
    )
    how = F.when(F.col("unit").isNotNull(), "EXACT").when(F.col("only_unit").isNotNull(), "STATEMENT").otherwise("MISSING")
    return joined.select("requested", F.coalesce("unit", "only_unit").alias("resolved"), how.alias("how"))


@query(
    "rp_parse_coverage",
    """
WITH p AS (SELECT count(*) AS discovered, count(*) FILTER (regexp_matches(html, '<title>[^<*]+</title>')) AS parsed FROM pages)
SELECT discovered, parsed, round(parsed / discovered, 3) AS ratio, parsed / discovered < 0.9 AS below_threshold FROM p""",
)
def rp_parse_coverage(t):
    p = t.pages.agg(
        F.count("*").alias("discovered"), F.count_if(F.col("html").rlike("<title>[^<*]+</title>")).alias("parsed")
    )
    return p.select(
        "discovered", "parsed",
        share(F.col("parsed"), F.col("discovered"), 3).alias("ratio"),
        (F.col("parsed") / F.greatest(F.col("discovered"), F.lit(1)) < 0.9).alias("below_threshold"),
    )


def reference_edges(t):
    """Parts as fragments in chains of 20, each referring to the part before; every fourth chain also
    closes in a circle, and some parts refer to what is missing."""
    key = F.col("p_partkey")
    missing = (key + 1_000_000_000_000).cast("bigint")
    targets = F.array_compact(
        F.array(
            F.when(key % 20 > 0, key - 1),
            F.when(key % 80 == 40, key + 3),
            F.when(key % 97 == 5, missing),
        )
    )
    return t.part.select(key.alias("fragment"), F.explode_outer(targets).alias("ref"))


EDGES_SQL = """
e AS (SELECT p_partkey AS fragment, p_partkey - 1 AS ref FROM part WHERE p_partkey % 20 > 0
      UNION ALL SELECT p_partkey, p_partkey + 3 FROM part WHERE p_partkey % 80 = 40
      UNION ALL SELECT p_partkey, p_partkey + 1000000000000 FROM part WHERE p_partkey % 97 = 5)"""


@query(
    "rp_reference_closure",
    f"""
WITH RECURSIVE {EDGES_SQL},
w AS (SELECT fragment AS root, ref, 0 AS level FROM e UNION
      SELECT w.root, e.ref, w.level + 1 FROM w JOIN e ON e.fragment = w.ref WHERE w.level < 60),
p AS (SELECT root, ref, min(level) AS level, max(level) AS last FROM w GROUP BY ALL),
c AS (SELECT root, count(*) AS n_refs, CAST(max(level) AS INTEGER) AS max_level, max(last) = 60 AS circle FROM p GROUP BY root)
SELECT p_partkey AS root, coalesce(n_refs, 0) AS n_refs, max_level, coalesce(circle, false) AS degraded
FROM part LEFT JOIN c ON root = p_partkey""",
)
def rp_reference_closure(t):
    """Chains longer than 16 are followed to their ends; the SQL walks 60 steps, which only a circle allows."""
    roots = t.part.select(F.col("p_partkey").alias("root"))
    return reference_closure(roots, reference_edges(t), t.scratch("closure"))


@query(
    "rp_unresolved_refs",
    f"WITH {EDGES_SQL} SELECT fragment, ref FROM e WHERE ref NOT IN (SELECT p_partkey FROM part)",
)
def rp_unresolved_refs(t):
    edges = reference_edges(t).filter(F.col("ref").isNotNull())
    return not_exists_in(edges, "ref", t.part, "p_partkey")


@query(
    "rp_clear_winner",
    """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity > 40 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem),
n AS (SELECT *, count(*) FILTER (status = 'PASS') OVER (PARTITION BY l_orderkey) AS n_pass FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, n_pass,
  CASE WHEN NOT (n_pass = 1 AND status = 'PASS') THEN 'PATCH_CONFLICT_NO_CLEAR_WINNER' END AS gate_code FROM n""",
)
def rp_clear_winner(t):
    rows = t.lineitem.select(
        "l_orderkey", *POSITION,
        F.concat_ws("-", *POSITION).alias("variant"),
        F.when(F.col("l_quantity") > 40, "PASS").otherwise("FAIL").alias("status"),
    )
    return cons.clear_winners(rows, "l_orderkey", "variant").drop("variant", "status")


@query(
    "rp_consensus_gate",
    f"""
WITH {CONSENSUS_SQL}
SELECT coalesce(decision, 'NONE') AS decision, CASE WHEN decision = 'MANUAL_REVIEW' THEN 'PATCH_CONVERGENCE_REVIEW_REQUIRED' END
  AS gate_code, family, count(*) AS n FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def rp_consensus_gate(t):
    """Patch rows (orders) blocked or labelled by the decision of their statement."""
    d = decisions(t).select("l_orderkey", "decision", "family")
    joined = t.orders.select("o_orderkey").join(d, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    labelled = joined.select(
        F.coalesce("decision", F.lit("NONE")).alias("decision"), cons.gate_code(F.col("decision")).alias("gate_code"), "family"
    )
    return counted(labelled, "decision", "gate_code", "family")


@query(
    "rp_primary_blocker",
    f"""
WITH o AS (SELECT CASE WHEN o_totalprice > 450000 THEN 'CRITICAL_GAP' ELSE 'COMPLETE' END AS evidence,
  CASE WHEN o_custkey % 2 = 0 THEN 'gap_code' END AS gap, {reason_sql('o_custkey')} AS gate_reason,
  CASE WHEN o_orderstatus = 'P' THEN 'VALIDATE_PARAM_INSUFFICIENT' END AS acceptance,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'PATCH_FAMILY_SPEC_MISSING' END AS selection,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'BLOCKED' ELSE 'NEEDS_REVIEW' END AS delivery FROM orders)
SELECT CASE WHEN evidence = 'CRITICAL_GAP' THEN upper(coalesce(gap, 'VERIFICATION_CRITICAL_GAP'))
  WHEN gate_reason = 'SEMANTIC_GATE_FAIL' THEN gate_reason WHEN acceptance IS NOT NULL THEN acceptance
  WHEN selection IS NOT NULL THEN selection WHEN delivery = 'BLOCKED' THEN 'DELIVERY_BLOCKED' END AS code,
  CASE WHEN evidence = 'CRITICAL_GAP' THEN 'verification' WHEN gate_reason = 'SEMANTIC_GATE_FAIL' OR acceptance IS NOT NULL
  THEN 'validate' WHEN selection IS NOT NULL OR delivery = 'BLOCKED' THEN 'patch_generate' END AS phase, count(*) AS n
FROM o GROUP BY ALL""",
)
def rp_primary_blocker(t):
    priority = F.col("o_orderpriority")
    blocker = reports.primary_blocker(
        F.when(F.col("o_totalprice") > 450000, "CRITICAL_GAP").otherwise("COMPLETE"),
        F.when(F.col("o_custkey") % 2 == 0, "gap_code"),
        reason("o_custkey"),
        F.when(F.col("o_orderstatus") == "P", "VALIDATE_PARAM_INSUFFICIENT"),
        F.when(priority == "5-LOW", "PATCH_FAMILY_SPEC_MISSING"),
        F.when(priority == "4-NOT SPECIFIED", "BLOCKED").otherwise("NEEDS_REVIEW"),
    )
    return counted(t.orders.select(blocker.alias("b")).select("b.*"), "code", "phase")


PART_PRIORITY = (("ring", 0), ("large", 1), ("bolt", 2), ("small", 90))


@query(
    "rp_reason_by_priority",
    """
WITH x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS r FROM part),
y AS (SELECT *, CASE WHEN starts_with(r, 'ring') THEN 0 WHEN starts_with(r, 'large') THEN 1 WHEN starts_with(r, 'bolt') THEN 2
  WHEN starts_with(r, 'small') THEN 90 ELSE 50 END AS p FROM x)
SELECT p_partkey, r AS reason FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p, r) AS rn FROM y) WHERE rn = 1""",
)
def rp_reason_by_priority(t):
    return t.part.select(
        "p_partkey", reports.leading_reason(F.split("p_name", " "), PART_PRIORITY).alias("reason")
    )


@query(
    "rp_evidence_availability",
    f"""
WITH o AS (SELECT o_totalprice > 450000 AS gap, {reason_sql('o_custkey')} AS code,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS checked, o_orderpriority < '3' AS refs,
  CASE WHEN o_orderpriority < '4' THEN 'DB_COUNT' ELSE 'STRUCTURE' END AS level FROM orders),
s AS (SELECT CASE WHEN gap THEN 1 WHEN code = 'VALIDATE_SECURITY_DOLLAR_SUBSTITUTION' THEN 2 WHEN checked AND (refs OR level = 'DB_COUNT')
  THEN 3 WHEN checked THEN 4 ELSE 5 END AS c FROM o)
SELECT (['MISSING', 'MISSING', 'READY', 'PARTIAL', 'MISSING'])[c] AS state, (['CRITICAL_GAP_UNVERIFIED_OUTPUT',
  'SKIPPED_BY_SECURITY_BLOCK', NULL, 'STRUCTURE_ONLY_OR_REFERENCE_MISSING', 'SEMANTIC_EVIDENCE_NOT_COLLECTED'])[c] AS reason,
  count(*) AS n FROM s GROUP BY ALL""",
)
def rp_evidence_availability(t):
    checked = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    priority = F.col("o_orderpriority")
    state = reports.evidence_availability(
        F.when(F.col("o_totalprice") > 450000, "CRITICAL_GAP").otherwise("COMPLETE"),
        reason("o_custkey"),
        checked,
        priority < "3",
        F.when(priority < "4", "DB_COUNT").otherwise("STRUCTURE"),
    )
    return counted(t.orders.select(state.alias("s")).select("s.*"), "state", "reason")


@query(
    "rp_status_counts",
    """
SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM
  (SELECT unnest(['F', 'O', 'P', 'SKIPPED']) AS s)""",
)
def rp_status_counts(t):
    return fixed_status_counts(t.orders, "o_orderstatus", ["F", "O", "P", "SKIPPED"])


@query(
    "rp_proposal_rows",
    """
SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS n_candidates, concat_ws(',',
  CASE WHEN bool_or(l_quantity > 45) THEN 'FULL_SCAN' END, CASE WHEN bool_or(l_discount > 0.085) THEN 'NO_LIMIT' END,
  CASE WHEN bool_or(l_tax > 0.075) THEN 'SELECT_STAR' END) AS issue_codes,
  CASE WHEN bool_or(l_quantity > 45) THEN 'ACTIONABLE' ELSE 'UNKNOWN' END AS verdict FROM lineitem GROUP BY l_orderkey""",
)
def rp_proposal_rows(t):
    """Issue codes come from a fixed list, so each is a flag that combines in the map tasks."""
    codes = rules.matching_codes(
        [
            (F.bool_or(F.col("l_quantity") > 45), "FULL_SCAN"),
            (F.bool_or(F.col("l_discount") > 0.085), "NO_LIMIT"),
            (F.bool_or(F.col("l_tax") > 0.075), "SELECT_STAR"),
        ]
    )
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("n_candidates"),
        F.array_join(codes, ",").alias("issue_codes"),
        F.when(F.bool_or(F.col("l_quantity") > 45), "ACTIONABLE").otherwise("UNKNOWN").alias("verdict"),
    )
