"""Ranks and per-key selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.functions.rules import DELIVERY_RANK, first_match
from queryproof.operators.lookup import last_row_wins
from queryproof.operators.ranking import best_per_key, pick_max, ranked_rows, top_per_key
from queryproof.plans.registry import pair, query


@query(
    "wn_row_number",
    """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)
       AS row_rank FROM orders""",
)
def wn_row_number(t):
    """Every order ranked inside its customer; ranges of the order split a customer over many tasks."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    ranked = ranked_rows(rows, ["o_custkey"], [("o_orderdate", "desc"), ("o_orderkey", "asc")], "row_rank")
    return ranked.select("o_orderkey", "o_custkey", "row_rank")


@pair(
    "wn_distinct_on_pair",
    "SELECT DISTINCT ON (o_orderpriority) o_orderpriority FROM orders ORDER BY o_orderpriority",
    "SELECT DISTINCT o_orderpriority FROM orders",
    "o_orderpriority:s",
)
def wn_distinct_on_pair(t):
    first = best_per_key(
        t.orders, ["o_orderpriority"], [("o_orderpriority", "asc"), ("o_orderkey", "asc")]
    )
    return first.select("o_orderpriority"), t.orders.select("o_orderpriority").distinct()


@query(
    "wn_top_per_key",
    """
SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def wn_top_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    top = top_per_key(rows, ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 3)
    return top.select("o_custkey", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


# Delivery tier of an order in the bound data: a stand-in for the tier column of patch rows.
_TIER_SQL = (
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'AUTO_PATCH' WHEN o_orderpriority = '2-HIGH' THEN "
    "'PATCHABLE_WITH_REWRITE' WHEN o_orderpriority = '3-MEDIUM' THEN 'MANUAL_REVIEW' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'BLOCKED' ELSE '' END"
)


def delivery_tier():
    p = F.col("o_orderpriority")
    return first_match(
        [
            (p == "1-URGENT", "AUTO_PATCH"),
            (p == "2-HIGH", "PATCHABLE_WITH_REWRITE"),
            (p == "3-MEDIUM", "MANUAL_REVIEW"),
            (p == "4-NOT SPECIFIED", "BLOCKED"),
        ],
        "",
    )


@query(
    "rp_best_delivery_row",
    f"""
WITH o AS (SELECT o_custkey, o_orderkey, tier, CASE WHEN tier IN ('AUTO_PATCH', 'READY_TO_APPLY') THEN 4
    WHEN tier = 'PATCHABLE_WITH_REWRITE' THEN 3 WHEN tier IN ('REVIEW_ONLY', 'MANUAL_REVIEW') THEN 2
    WHEN tier = 'NEEDS_REVIEW' THEN 1 WHEN tier = 'BLOCKED' THEN 0 ELSE -1 END AS delivery_rank
  FROM (SELECT *, {_TIER_SQL} AS tier FROM orders))
SELECT o_custkey, o_orderkey, tier, delivery_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY delivery_rank DESC, o_orderkey) AS rn FROM o) WHERE rn = 1 AND delivery_rank >= 0""",
)
def rp_best_delivery_row(t):
    """Best row per key by delivery rank, earliest row on ties; keys with only unknown tiers have none."""
    rows = t.orders.select("o_custkey", "o_orderkey", delivery_tier().alias("tier"))
    rows = rows.withColumn(
        "delivery_rank", F.coalesce(DELIVERY_RANK.lookup(F.col("tier")), F.lit(-1))
    ).filter("delivery_rank >= 0")
    best = rows.groupBy("o_custkey").agg(
        pick_max(["o_orderkey", "tier", "delivery_rank"], [F.col("delivery_rank"), -F.col("o_orderkey")]).alias("b")
    )
    return best.select("o_custkey", "b.*")


@query(
    "rp_best_acceptance_row",
    """
WITH o AS (SELECT o_custkey, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END
    + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_orderpriority = '3-MEDIUM' THEN 1
      ELSE 0 END AS acceptance_rank FROM orders)
SELECT o_custkey, o_orderkey, acceptance_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY acceptance_rank DESC, o_orderkey) AS rn FROM o) WHERE rn = 1""",
)
def rp_best_acceptance_row(t):
    """Status and readiness each add up to two points; the first row with the most points wins."""
    status = F.col("o_orderstatus")
    ready = F.col("o_orderpriority")
    points = F.when(status == "F", 2).when(status == "P", 1).otherwise(0) + F.when(
        ready.isin("1-URGENT", "2-HIGH"), 2
    ).when(ready == "3-MEDIUM", 1).otherwise(0)
    rows = t.orders.select("o_custkey", "o_orderkey", points.alias("acceptance_rank"))
    best = rows.groupBy("o_custkey").agg(
        pick_max(["o_orderkey", "acceptance_rank"], [F.col("acceptance_rank"), -F.col("o_orderkey")]).alias("b")
    )
    return best.select("o_custkey", "b.*")


@query(
    "rp_last_row_wins",
    """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def rp_last_row_wins(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    latest = last_row_wins(rows, ["user_id"], [("ts", "desc"), ("event_id", "desc")])
    return latest.select("user_id", "event_id", "event_type")


@query(
    "rp_first_seen_dedup",
    """
WITH f AS (SELECT user_id, event_type || ':' || json_extract_string(props, '$.k') AS code,
                  min(event_id) AS first_pos FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_pos) AS rn FROM f)
SELECT user_id, string_agg(code, ',' ORDER BY rn) AS codes FROM r GROUP BY user_id""",
)
def rp_first_seen_dedup(t):
    """The different codes of each key in order of appearance; a key has as many as there are codes."""
    code = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    first = t.events.groupBy("user_id", code.alias("code")).agg(F.min("event_id").alias("first_pos"))
    return first.groupBy("user_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "code"))), lambda s: s["code"]), ","
        ).alias("codes")
    )
