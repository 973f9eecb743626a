"""Sorting, paging, top-k and the wrapper rewrites around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.operators import audits, filters
from queryproof.operators.counting import top_codes
from queryproof.operators.equivalence import compare_ordered, compare_ordered_bags
from queryproof.operators.ordering import non_constant_order
from queryproof.operators.sequences import MODULI, compare_sequences
from queryproof.plans.filters import CUSTOMER_COLUMNS, ORDER_COLUMNS
from queryproof.plans.registry import CUSTOMER, ORDERS, bag_sql, hash_sql, pair, query

RECENT_SQL = "ORDER BY o_orderdate DESC, o_orderkey"


def recent():
    return [F.desc("o_orderdate"), F.asc("o_orderkey")]


@query(
    "sl_order_limit_offset",
    f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders {RECENT_SQL} LIMIT 100 OFFSET 20",
)
def sl_order_limit_offset(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate").orderBy(
        *recent()
    ).offset(20).limit(100).drop("o_orderdate")


@pair(
    "sl_order_constant_pair",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer",
    CUSTOMER,
)
def sl_order_constant_pair(t):
    """Literal sort keys order nothing and are dropped; ``ORDER BY 1`` is a column and is kept."""
    keys = non_constant_order([None, "x"], t.customer.columns)
    before = t.customer.orderBy(F.lit(None).cast("string"), F.lit("x"))
    return before, t.customer.orderBy(*keys) if keys else t.customer


@query(
    "sl_large_limit_audit",
    """
SELECT 'lineitem' AS result, count(*) AS n_rows, 1000000::BIGINT AS row_limit, count(*) <= 1000000 AS removable
FROM lineitem UNION ALL SELECT 'orders', count(*), 1000, count(*) <= 1000 FROM orders""",
)
def sl_large_limit_audit(t):
    big = audits.limit_removal(t.lineitem, 1_000_000).select(F.lit("lineitem").alias("result"), "*")
    small = audits.limit_removal(t.orders, 1_000).select(F.lit("orders").alias("result"), "*")
    return big.unionByName(small)


_POSITIONS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey {d}) AS pos FROM orders"


@query(
    "sl_order_sensitive_compare",
    f"""
WITH b AS ({_POSITIONS.format(d="")}), a AS ({_POSITIONS.format(d="DESC")}),
c AS (SELECT count(*) AS n, count(*) FILTER (b.o_orderkey <> a.o_orderkey) AS d FROM b JOIN a USING (pos))
SELECT 'same order' AS compared, n AS n_before, n AS n_after, 0 AS n_positions_different, 'MATCH' AS ordered_status FROM c
UNION ALL SELECT 'ties reversed', n, n, d, CASE WHEN d = 0 THEN 'MATCH' ELSE 'MISMATCH' END FROM c""",
)
def sl_order_sensitive_compare(t):
    """The whole table, position by position: equal as a bag, yet different once ties are reversed."""
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    up = [("o_orderdate", "asc"), ("o_orderkey", "asc")]
    reversed_ties = [("o_orderdate", "asc"), ("o_orderkey", "desc")]
    same = compare_ordered(o, up, o, up)
    swapped = compare_ordered(o, up, o, reversed_ties)
    return same.select(F.lit("same order").alias("compared"), "*").unionByName(
        swapped.select(F.lit("ties reversed").alias("compared"), "*")
    )


_SEQUENCE = "SELECT o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey {d}) AS pos FROM orders"
_SEQUENCE_SPEC = "o_orderkey:v o_orderdate:v o_orderstatus:s pos:v"


@query(
    "sl_order_fingerprint",
    f"""
WITH b AS ({bag_sql(_SEQUENCE.format(d=""), _SEQUENCE_SPEC)}), a AS ({bag_sql(_SEQUENCE.format(d="DESC"), _SEQUENCE_SPEC)})
SELECT b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after,
  CASE WHEN b.fp = a.fp THEN 'MATCH' ELSE 'MISMATCH' END AS ordered_status FROM a, b""",
)
def sl_order_fingerprint(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    up = [("o_orderdate", "asc"), ("o_orderkey", "asc")]
    down = [("o_orderdate", "asc"), ("o_orderkey", "desc")]
    c = compare_ordered_bags(o, up, o, down, algorithm="md5")
    return c.select(
        "n_before", "n_after", "fp_before", "fp_after", F.col("fingerprint_status").alias("ordered_status")
    )


_HORNER = "list_reduce(list_prepend(0, list(h % {p} ORDER BY {order})), lambda later, x: (later * {b} + x) % {p})"


def _sequence_sql(side: str, rows: str, reverse: str) -> str:
    """The polynomial of row hashes from the last row to the first, for both moduli."""
    folds = ", ".join(_HORNER.format(p=p, b=b, order=reverse) for p, b in MODULI)
    return (
        f"{side} AS (SELECT count(*) AS n, concat_ws(':', count(*), {folds}) AS fp "
        f"FROM (SELECT *, {hash_sql(_SEQUENCE_SPEC.removesuffix(' pos:v'))} AS h FROM ({rows}) q) t)"
    )


_ROWS = "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders"


@query(
    "sl_order_polynomial",
    f"""
WITH {_sequence_sql("up", _ROWS, "o_orderdate DESC, o_orderkey DESC")},
{_sequence_sql("down", _ROWS, "o_orderdate DESC, o_orderkey")},
{_sequence_sql("fewer", _ROWS + " WHERE o_orderstatus <> 'P'", "o_orderdate DESC, o_orderkey DESC")}
SELECT 'same order' AS compared, b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after, 'MATCH' AS ordered_status FROM up b, up a
UNION ALL SELECT 'ties reversed', b.n, a.n, b.fp, a.fp, 'MISMATCH' FROM up b, down a
UNION ALL SELECT 'rows dropped', b.n, a.n, b.fp, a.fp, 'MISMATCH' FROM up b, fewer a""",
)
def sl_order_polynomial(t):
    """Ordered fingerprints put together from sorted parts: equal orders match, reversed ties and dropped rows don't."""
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    up, down = ([("o_orderdate", "asc"), ("o_orderkey", d)] for d in ("asc", "desc"))
    cases = [("same order", o, up), ("ties reversed", o, down), ("rows dropped", o.filter("o_orderstatus <> 'P'"), up)]
    rows = [compare_sequences(o, up, a, order, "md5").select(F.lit(name).alias("compared"), "*") for name, a, order in cases]
    return reduce(DataFrame.unionByName, rows)


@pair(
    "sl_subquery_wrapper_page_pair",
    f"SELECT {ORDER_COLUMNS} FROM (SELECT {ORDER_COLUMNS} FROM orders) s {RECENT_SQL} LIMIT 50",
    f"SELECT {ORDER_COLUMNS} FROM orders {RECENT_SQL} LIMIT 50",
    ORDERS,
)
def sl_subquery_wrapper_page_pair(t):
    inner = t.orders.select(*t.orders.columns).alias("s")
    wrapped = inner.select(*[F.col(f"s.{c}") for c in t.orders.columns])
    return wrapped.orderBy(*recent()).limit(50), t.orders.orderBy(*recent()).limit(50)


@pair(
    "sl_filter_wrapper_pair",
    f"SELECT {ORDER_COLUMNS} FROM (SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'O') f",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'O'",
    ORDERS,
)
def sl_filter_wrapper_pair(t):
    given = [("O", F.col("o_orderstatus") == "O"), (None, F.col("o_orderpriority") == "none")]
    inside = filters.optional_filter(t.orders, given).alias("f")
    wrapped = inside.select(*[F.col(f"f.{c}") for c in t.orders.columns])
    return wrapped, filters.optional_filter(t.orders.select(*t.orders.columns), given)


@pair(
    "sl_cte_inline_pair",
    f"WITH recent AS (SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') "
    f"SELECT {ORDER_COLUMNS} FROM recent {RECENT_SQL} LIMIT 20",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' {RECENT_SQL} LIMIT 20",
    ORDERS,
)
def sl_cte_inline_pair(t):
    before = t.spark.sql(
        "WITH recent AS (SELECT * FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00') "
        "SELECT * FROM recent ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
        orders=t.orders,
    )
    inline = t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return before, inline.orderBy(*recent()).limit(20)


@query(
    "sl_topk_codes",
    """
SELECT json_extract_string(props, '$.k') AS code, count(*) AS n FROM events GROUP BY 1
ORDER BY n DESC, code LIMIT 10""",
)
def sl_topk_codes(t):
    counts = t.events.groupBy(F.get_json_object("props", "$.k").alias("code")).agg(F.count("*").alias("n"))
    return top_codes(counts, 10)
