"""Unions, key intersections and differences, candidate pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.functions.text import strip
from queryproof.operators.joins import exists_in, not_exists_in
from queryproof.operators.pool import candidate_pool
from queryproof.operators.equivalence import compare_bags
from queryproof.plans.registry import pair, query


def _slice(t, status):
    return t.orders.filter(F.col("o_orderstatus") == status).select("o_custkey", "o_orderpriority")


_SLICES = (
    "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' {kind} "
    "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"
)


@query("so_union_distinct", _SLICES.format(kind="UNION"))
def so_union_distinct(t):
    return _slice(t, "O").unionByName(_slice(t, "F")).distinct()


@query("so_union_all", _SLICES.format(kind="UNION ALL"))
def so_union_all(t):
    return _slice(t, "O").unionByName(_slice(t, "F"))


@pair(
    "so_union_wrapper_pair",
    f"SELECT o_custkey, o_orderpriority FROM ({_SLICES.format(kind='UNION')}) su",
    _SLICES.format(kind="UNION"),
    "o_custkey:v o_orderpriority:s",
)
def so_union_wrapper_pair(t):
    union = _slice(t, "O").unionByName(_slice(t, "F")).distinct()
    return union.alias("su").select("su.o_custkey", "su.o_orderpriority"), union


@query(
    "so_union_kind_audit",
    f"""
SELECT (SELECT count(*) FROM ({_SLICES.format(kind="UNION ALL")}) a) AS n_union_all,
       (SELECT count(*) FROM ({_SLICES.format(kind="UNION")}) d) AS n_union,
       (SELECT count(*) FROM ({_SLICES.format(kind="UNION ALL")}) a)
         = (SELECT count(*) FROM ({_SLICES.format(kind="UNION")}) d) AS interchangeable""",
)
def so_union_kind_audit(t):
    """UNION and UNION ALL may replace each other only when the branches hold no copies."""
    union_all = _slice(t, "O").unionByName(_slice(t, "F"))
    return compare_bags(union_all, union_all.distinct()).select(
        F.col("n_before").alias("n_union_all"),
        F.col("n_after").alias("n_union"),
        (F.col("fp_before") == F.col("fp_after")).alias("interchangeable"),
    )


@query(
    "so_key_intersection",
    "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' "
    "INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
)
def so_key_intersection(t):
    passed = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("key")).distinct()
    unverified = t.lineitem.filter(F.col("l_returnflag") == "R")
    return exists_in(passed, "key", unverified, "l_orderkey")


@query(
    "so_missing_expected",
    "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders "
    "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'",
)
def so_missing_expected(t):
    observed = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
    expected = t.customer.select(F.col("c_custkey").alias("key")).distinct()
    return not_exists_in(expected, "key", observed, "o_custkey")


@query(
    "so_failure_union",
    """
SELECT o_orderkey AS key, 'validate' AS phase, o_orderpriority AS reason, o_orderstatus AS status
FROM orders WHERE o_orderstatus <> 'F'
UNION ALL
SELECT event_id, 'runtime', coalesce(json_extract_string(props, '$.reason'), 'RUNTIME_RETRY_EXHAUSTED'), 'FAILED'
FROM events WHERE event_type = 'error'""",
)
def so_failure_union(t):
    acceptance = t.orders.filter(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("key"),
        F.lit("validate").alias("phase"),
        F.col("o_orderpriority").alias("reason"),
        F.col("o_orderstatus").alias("status"),
    )
    reason = F.coalesce(F.get_json_object("props", "$.reason"), F.lit("RUNTIME_RETRY_EXHAUSTED"))
    log = t.events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("key"),
        F.lit("runtime").alias("phase"),
        reason.alias("reason"),
        F.lit("FAILED").alias("status"),
    )
    return acceptance.unionByName(log)


@query(
    "so_candidate_pool",
    r"""
WITH c AS (SELECT source AS key, CASE WHEN lang = 'en' THEN 'rule' ELSE 'llm' END AS origin, doc_id AS position,
                  regexp_replace(text, '^\s+|\s+$', '', 'g') AS txt FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key, txt ORDER BY origin = 'rule', position) AS rn
      FROM c WHERE txt <> '')
SELECT key, origin, concat(key, ':', origin, ':c', position) AS candidate_id FROM r WHERE rn = 1""",
)
def so_candidate_pool(t):
    docs = t.documents.select(
        F.col("source").alias("key"), F.col("doc_id").alias("position"), strip(F.col("text")).alias("text"), "lang"
    )
    generated = docs.filter(F.col("lang") != "en").drop("lang")
    rules = docs.filter(F.col("lang") == "en").drop("lang")
    return candidate_pool([("llm", generated), ("rule", rules)])
