"""Joins, EXISTS forms and the audits that decide whether a join rewrite is safe."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.operators import audits
from queryproof.operators.equivalence import compare_bags
from queryproof.operators.joins import exists_in, not_exists_in, outer_join
from queryproof.operators.lookup import enrich
from queryproof.plans.registry import CUSTOMER, bag_sql, pair, query


def on_customer():
    return F.col("o_custkey") == F.col("c_custkey")


@query(
    "jn_inner_equi",
    """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'O' AND (c.c_name ILIKE '%0001%' OR c.c_mktsegment ILIKE '%build%')
ORDER BY o.o_orderkey DESC LIMIT 50 OFFSET 10""",
)
def jn_inner_equi(t):
    keyword = F.col("c_name").ilike("%0001%") | F.col("c_mktsegment").ilike("%build%")
    return (
        t.orders.join(t.customer, on_customer())
        .filter((F.col("o_orderstatus") == "O") & keyword)
        .select("o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_mktsegment")
        .orderBy(F.desc("o_orderkey"))
        .offset(10)
        .limit(50)
    )


def _filtered_sides(t):
    customers = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey", "c_name")
    orders = t.orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")
    return customers, orders


_SIDES = """
WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, c_name, o_orderkey, o_custkey FROM c {kind} JOIN o ON c_custkey = o_custkey"""


def _join_kind(t, how):
    customers, orders = _filtered_sides(t)
    return outer_join(customers, "c_custkey", orders, "o_custkey", how)


@query("jn_left", _SIDES.format(kind="LEFT"))
def jn_left(t):
    return _join_kind(t, "left")


@query("jn_right", _SIDES.format(kind="RIGHT"))
def jn_right(t):
    return _join_kind(t, "right")


@query("jn_full", _SIDES.format(kind="FULL OUTER"))
def jn_full(t):
    return _join_kind(t, "full")


@pair(
    "jn_cross",
    "SELECT o_orderkey, c_nationkey FROM orders CROSS JOIN customer WHERE o_custkey = c_custkey",
    "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "o_orderkey:v c_nationkey:v",
)
def jn_cross(t):
    """A cross join whose WHERE equates the keys is an inner join; Spark plans it as one."""
    before = t.spark.sql(
        "SELECT o_orderkey, c_nationkey FROM {orders} CROSS JOIN {customer} WHERE o_custkey = c_custkey",
        orders=t.orders,
        customer=t.customer,
    )
    after = t.orders.join(t.customer, on_customer()).select("o_orderkey", "c_nationkey")
    return before, after


_LEFT_ROWS = (
    "SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c {kind} JOIN "
    "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.o_custkey = c.c_custkey {where}"
)
_LEFT_SPEC = "c_custkey:v o_orderkey:v o_orderstatus:s"


@query(
    "jn_left_to_inner_audit",
    f"""
WITH b AS ({bag_sql(_LEFT_ROWS.format(kind="LEFT", where="WHERE o.o_orderstatus = 'O'"), _LEFT_SPEC)}),
a AS ({bag_sql(_LEFT_ROWS.format(kind="INNER", where="WHERE o.o_orderstatus = 'O'"), _LEFT_SPEC)}),
b2 AS ({bag_sql(_LEFT_ROWS.format(kind="LEFT", where=""), _LEFT_SPEC)}),
a2 AS ({bag_sql(_LEFT_ROWS.format(kind="INNER", where=""), _LEFT_SPEC)})
SELECT 'null-rejecting' AS predicate, b.n AS n_left, a.n AS n_inner, b.n - a.n AS n_null_extended_kept,
       CASE WHEN b.fp = a.fp THEN 'SAFE' ELSE 'UNSAFE' END AS decision FROM b, a
UNION ALL
SELECT 'none', b2.n, a2.n, b2.n - a2.n, CASE WHEN b2.fp = a2.fp THEN 'SAFE' ELSE 'UNSAFE' END FROM b2, a2""",
)
def jn_left_to_inner_audit(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")

    def rows(how, predicate):
        if how == "left":
            joined = outer_join(t.customer, "c_custkey", urgent, "o_custkey", how)
        else:
            joined = t.customer.join(urgent, on_customer())
        kept = joined if predicate is None else joined.filter(predicate)
        return kept.select("c_custkey", "o_orderkey", "o_orderstatus")

    def audit(label, predicate):
        compared = compare_bags(rows("left", predicate), rows("inner", predicate))
        return compared.select(
            F.lit(label).alias("predicate"),
            F.col("n_before").alias("n_left"),
            F.col("n_after").alias("n_inner"),
            (F.col("n_before") - F.col("n_after")).alias("n_null_extended_kept"),
            F.when(F.col("fp_before") == F.col("fp_after"), "SAFE").otherwise("UNSAFE").alias("decision"),
        )

    return audit("null-rejecting", F.col("o_orderstatus") == "O").unionByName(audit("none", None))


@query(
    "jn_elimination_audit",
    """
SELECT 'lineitem->orders' AS join_edge,
  (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_duplicated_right_keys,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphan_rows,
  true AS left_join_removable, true AS inner_join_removable
UNION ALL
SELECT 'orders->lineitem', d, o, d = 0, d = 0 AND o = 0 FROM (SELECT
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS d,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS o)
UNION ALL
SELECT 'orders->customer', d, o, d = 0, d = 0 AND o = 0 FROM (SELECT 0 AS d,
  (SELECT count(*) FROM orders WHERE o_custkey NOT IN
    (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS o)""",
)
def jn_elimination_audit(t):
    some = t.customer.filter(F.col("c_mktsegment") != "BUILDING")
    cases = [
        ("lineitem->orders", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ("orders->lineitem", t.orders, "o_orderkey", t.lineitem, "l_orderkey"),
        ("orders->customer", t.orders, "o_custkey", some, "c_custkey"),
    ]
    out = None
    for label, left, lk, right, rk in cases:
        row = audits.join_elimination(left, lk, right, rk).select(F.lit(label).alias("join_edge"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_TRIPLE = (
    "SELECT o_orderkey, c_custkey, n_name FROM {sides} "
    "WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey"
)


@pair(
    "jn_reorder_pair",
    _TRIPLE.format(sides="orders, customer, nation"),
    _TRIPLE.format(sides="nation, customer, orders"),
    "o_orderkey:v c_custkey:v n_name:s",
)
def jn_reorder_pair(t):
    on_nation = F.col("c_nationkey") == F.col("n_nationkey")
    cols = ["o_orderkey", "c_custkey", "n_name"]
    before = t.orders.join(t.customer, on_customer()).join(t.nation, on_nation).select(cols)
    after = t.nation.join(t.customer, on_nation).join(t.orders, on_customer()).select(cols)
    return before, after


@query(
    "jn_consolidation_report",
    """
WITH e AS (SELECT 'customer' AS side, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL
           UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL
           UNION ALL SELECT 'orders', c_nationkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey
                     GROUP BY ALL)
SELECT k AS hub_key, CAST(count(*) AS BIGINT) AS n_sides, string_agg(side, ',' ORDER BY side) AS sides,
       CAST(sum(n) AS BIGINT) AS n_rows
FROM e GROUP BY k HAVING count(*) >= 2""",
)
def jn_consolidation_report(t):
    """Tables joined to the same hub key. Each side is counted per key first, so the edge table has
    at most one row per (side, key) and the list of sides has at most three names."""

    def side(label, df, key):
        counts = df.groupBy(F.col(key).alias("hub_key")).agg(F.count("*").alias("n"))
        return counts.select(F.lit(label).alias("side"), "hub_key", "n")

    per_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    orders = (
        per_customer.join(t.customer, on_customer())
        .groupBy(F.col("c_nationkey").alias("hub_key"))
        .agg(F.sum("n_orders").alias("n"))
        .select(F.lit("orders").alias("side"), "hub_key", "n")
    )
    edges = (
        side("customer", t.customer, "c_nationkey")
        .unionByName(side("supplier", t.supplier, "s_nationkey"))
        .unionByName(orders)
    )
    return (
        edges.groupBy("hub_key")
        .agg(
            F.count("*").alias("n_sides"),
            F.concat_ws(",", F.sort_array(F.collect_set("side"))).alias("sides"),
            F.sum("n").alias("n_rows"),
        )
        .filter(F.col("n_sides") >= 2)
    )


@query(
    "jn_exists_semi",
    "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
    "WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
)
def jn_exists_semi(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return exists_in(t.customer, "c_custkey", urgent, "o_custkey").select("c_custkey", "c_name")


@query(
    "jn_not_exists_anti",
    "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o "
    "WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
)
def jn_not_exists_anti(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return not_exists_in(t.customer, "c_custkey", urgent, "o_custkey").select("c_custkey", "c_name")


@pair(
    "jn_exists_to_in_pair",
    "SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
    "AND o.o_orderstatus = 'O')",
    "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    CUSTOMER,
)
def jn_exists_to_in_pair(t):
    open_orders = t.orders.filter(F.col("o_orderstatus") == "O")
    before = exists_in(t.customer, "c_custkey", open_orders, "o_custkey")
    after = t.spark.sql(
        "SELECT * FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O')",
        customer=t.customer,
        orders=t.orders,
    )
    return before, after


@query(
    "jn_not_in_null_audit",
    """
WITH i AS (SELECT nullif(o_custkey, 7) AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'with null keys' AS inner_side, (SELECT count(*) FROM i WHERE k IS NULL) AS n_inner_null,
  (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = c.c_custkey)) AS n_not_exists,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM i)) AS n_not_in,
  (SELECT count(*) FROM i WHERE k IS NULL) = 0 AS safe
UNION ALL SELECT 'null keys removed', 0,
  (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = c.c_custkey)),
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM i WHERE k IS NOT NULL)), true""",
)
def jn_not_in_null_audit(t):
    """NOT IN returns nothing when the inner side holds a NULL. The answer is built from an anti
    join and the NULL count, which scales, instead of a null-aware join, which broadcasts."""
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    keys = urgent.select(F.nullif(F.col("o_custkey"), F.lit(7)).alias("k"))

    def audit(label, inner):
        facts = inner.select(F.col("k").isNull().cast("int").alias("inner_null"), F.lit(0).alias("kept")).unionAll(
            not_exists_in(t.customer, "c_custkey", inner, "k").select(F.lit(0), F.lit(1))
        )
        counted = facts.agg(F.sum("inner_null").alias("n_inner_null"), F.sum("kept").alias("n_not_exists"))
        return counted.select(
            F.lit(label).alias("inner_side"),
            "n_inner_null",
            "n_not_exists",
            F.when(F.col("n_inner_null") > 0, F.lit(0)).otherwise(F.col("n_not_exists")).alias("n_not_in"),
            (F.col("n_inner_null") == 0).alias("safe"),
        )

    return audit("with null keys", keys).unionByName(
        audit("null keys removed", keys.filter(F.col("k").isNotNull()))
    )


@query(
    "jn_exists_to_join_audit",
    """
WITH f AS (SELECT 'customer->orders' AS join_edge,
  (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS n_semi,
  (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS n_join,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS max_fanout
UNION ALL SELECT 'orders->customer',
  (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
  (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey), 1)
SELECT *, n_semi = n_join AS safe FROM f""",
)
def jn_exists_to_join_audit(t):
    many = audits.join_fanout(t.customer, "c_custkey", t.orders, "o_custkey")
    one = audits.join_fanout(t.orders, "o_custkey", t.customer, "c_custkey")
    return many.select(F.lit("customer->orders").alias("join_edge"), "*").unionByName(
        one.select(F.lit("orders->customer").alias("join_edge"), "*")
    )


@pair(
    "jn_exists_self_pair",
    "SELECT * FROM customer u WHERE EXISTS (SELECT 1 FROM customer u2 WHERE u2.c_custkey = u.c_custkey)",
    "SELECT * FROM customer",
    CUSTOMER,
)
def jn_exists_self_pair(t):
    return exists_in(t.customer, "c_custkey", t.customer, "c_custkey"), t.customer


@query(
    "jn_lookup_left_wide",
    """
WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING'),
n AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20)
SELECT o_orderkey, coalesce(c_mktsegment, 'PENDING') AS segment, coalesce(n_name, 'unknown') AS nation,
       c_mktsegment IS NOT NULL AS has_customer
FROM orders LEFT JOIN c ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey""",
)
def jn_lookup_left_wide(t):
    customers = t.customer.filter(F.col("c_mktsegment") != "BUILDING")
    nations = t.nation.filter(F.col("n_nationkey") < 20)
    wide = enrich(t.orders, customers, "o_custkey", "c_custkey", [("c_custkey", "desc")], ["c_mktsegment", "c_nationkey"])
    wide = enrich(wide, nations, "c_nationkey", "n_nationkey", [("n_nationkey", "desc")], ["n_name"])
    return wide.select(
        "o_orderkey",
        F.coalesce("c_mktsegment", F.lit("PENDING")).alias("segment"),
        F.coalesce("n_name", F.lit("unknown")).alias("nation"),
        F.col("c_mktsegment").isNotNull().alias("has_customer"),
    )
