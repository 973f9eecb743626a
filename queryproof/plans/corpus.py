"""A statement corpus derived from the orders table: one statement per order.

The supplied tables hold no SQL text, so each order contributes the statement of its template with
its own key and status filled in. Templates cover every shape, feature and aggregate construct;
each carries the labels that a reader would give it, which serve as the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    text: str
    shape: str
    features: str = ""
    aggregation: str = "NONE"
    tables: str = "{t}"

    def about(self, domain: dict[str, str]) -> Template:
        text, tables = (_filled(x, domain) for x in (self.text, self.tables))
        return Template(text, self.shape, self.features, self.aggregation, tables)


def _filled(text: str, domain: dict[str, str]) -> str:
    for name, value in domain.items():
        text = text.replace(f"{{{name}}}", value)
    return text


#: Three small worlds: a table, its short name, a group column, a number, a text, and a second table and its link.
DOMAINS = (
    {"t": "books", "a": "b", "g": "genre", "n": "pages", "x": "title", "o": "loans", "l": "book_id"},
    {"t": "flights", "a": "f", "g": "airline", "n": "seats", "x": "origin", "o": "bookings", "l": "flight_no"},
    {"t": "sensors", "a": "sn", "g": "site", "n": "height", "x": "model", "o": "readings", "l": "sensor_key"},
)

PATTERNS = (
    Template("SELECT {x}, {n} FROM {t} WHERE {n} > :k", "STATIC_STATEMENT"),
    Template("SELECT {x} FROM {t} WHERE {g} = ':s' OR {x} = 'none' ORDER BY {n}", "STATIC_STATEMENT"),
    Template("SELECT {x} FROM {t} WHERE {n} BETWEEN :k AND 99999 ORDER BY {x} LIMIT 250", "STATIC_STATEMENT"),
    Template(
        "SELECT {a}.{x}, r.{l} FROM {t} {a} JOIN {o} r ON r.{l} = {a}.id WHERE {a}.{n} > :k",
        "STATIC_STATEMENT", "", "NONE", "{t},{o}",
    ),
    Template(
        "SELECT {a}.{g}, COUNT(*) FROM {t} {a} JOIN {o} r ON r.{l} = {a}.id WHERE r.id > :k GROUP BY {a}.{g}",
        "STATIC_STATEMENT", "", "GROUP_BY", "{t},{o}",
    ),
    Template(
        "SELECT DISTINCT {a}.{g} FROM {t} {a}, {o} r WHERE r.{l} = {a}.id AND r.id > :k", "STATIC_STATEMENT", "", "DISTINCT",
    ),
    Template("SELECT {g}, MAX({n}) FROM {t} WHERE {n} < :k GROUP BY {g}", "STATIC_STATEMENT", "", "GROUP_BY"),
    Template("SELECT {x} FROM {t} /* batch :k */ WHERE {g} = ':s' -- state :s", "STATIC_STATEMENT"),
    Template(
        "WITH recent AS (SELECT {x} FROM {t} WHERE {n} > :k) SELECT {x} FROM recent ORDER BY {x}",
        "STATIC_STATEMENT", "", "NONE", "{t},recent",
    ),
    Template("SELECT {x}, {n} FROM (SELECT {x}, {n} FROM {t} WHERE {n} > :k) part ORDER BY {n} DESC", "STATIC_SUBQUERY_WRAPPER"),
    Template("SELECT {x} FROM (SELECT {x}, {g} FROM {t}) AS part WHERE {g} = ':s'", "STATIC_SUBQUERY_WRAPPER"),
    Template("SELECT {x} AS {x}, {n} AS amount FROM {t} WHERE {g} = ':s'", "STATIC_ALIAS_PROJECTION"),
    Template("SELECT DISTINCT {a}.{g} FROM {t} AS {a} WHERE {a}.{n} > :k", "DISTINCT_ALIAS", "", "DISTINCT"),
    Template("SELECT {x} FROM {t} WHERE {n} > :k ORDER BY NULL", "ORDER_BY_CONSTANT"),
    Template("SELECT {x} FROM {t} WHERE {n} > :k ORDER BY 'fixed'", "ORDER_BY_CONSTANT"),
    Template("SELECT {x} FROM {t} WHERE TRUE AND {n} > :k", "BOOLEAN_TAUTOLOGY"),
    Template("SELECT {x} FROM {t} WHERE 1=1 ORDER BY {x}", "BOOLEAN_TAUTOLOGY"),
    Template("SELECT {x} FROM {t} WHERE {n} > :k AND {g} NOT IN (':s')", "IN_LIST_SINGLE_VALUE"),
    Template("SELECT {x} FROM {t} WHERE {g} IN (':s', 'Q') ORDER BY {x}", "STATIC_STATEMENT"),
    Template("SELECT {x} FROM {t} WHERE {g} = ':s' OR {g} = 'two words' ORDER BY {x}", "OR_SAME_COLUMN"),
    Template("SELECT {x}, CASE WHEN TRUE THEN {g} ELSE 'none' END AS grp FROM {t}", "CASE_WHEN_TRUE"),
    Template("SELECT {x}, COALESCE({g}, {g}) AS grp FROM {t} WHERE {n} > :k", "COALESCE_IDENTITY"),
    Template("SELECT {x}, COALESCE({g}, 'none') AS grp FROM {t} WHERE {n} > :k", "STATIC_STATEMENT"),
    Template("SELECT {x} FROM {t} WHERE {n} = 60 * 24", "EXPRESSION_FOLDING"),
    Template("SELECT {x} FROM {t} WHERE {n} > :k ORDER BY {x} LIMIT 5000000", "LIMIT_LARGE"),
    Template("SELECT {x} FROM {t} WHERE {g} <> NULL AND {n} > :k", "NULL_COMPARISON"),
    Template("SELECT DISTINCT ON ({g}) {g}, {n} FROM {t} ORDER BY {g}, {n}", "DISTINCT_ON", "", "DISTINCT"),
    Template(
        "SELECT {x} FROM {t} p WHERE EXISTS (SELECT 1 FROM {t} q WHERE q.id = p.id) AND {n} > :k", "EXISTS_SELF",
    ),
    Template(
        "SELECT {x} FROM {t} p WHERE EXISTS (SELECT 1 FROM {o} q WHERE q.{l} = p.id) AND {n} > :k",
        "STATIC_STATEMENT", "", "NONE", "{t},{o}",
    ),
    Template(
        "SELECT id FROM (SELECT id FROM lib.{t} WHERE {n} > :k UNION SELECT id FROM {o}) every ORDER BY id",
        "UNION_WRAPPER", "", "UNION", "{t},{o}",
    ),
    Template("SELECT id FROM {t} WHERE {n} > :k UNION ALL SELECT id FROM {o}", "UNION", "", "UNION", "{t},{o}"),
    Template("SELECT DISTINCT {g} FROM (SELECT DISTINCT {g} FROM {t} WHERE {n} > :k) kinds", "DISTINCT_WRAPPER", "", "DISTINCT"),
    Template(
        "SELECT {g}, top FROM (SELECT {g}, MAX({n}) AS top FROM {t} GROUP BY {g} HAVING MAX({n}) > :k) best ORDER BY top",
        "HAVING_WRAPPER", "", "HAVING",
    ),
    Template("SELECT {g}, top FROM (SELECT {g}, MAX({n}) AS top FROM {t} GROUP BY {g}) best LIMIT 20", "GROUP_BY_WRAPPER", "", "GROUP_BY"),
    Template("SELECT {a}.{g}, MIN({a}.{n}) AS low FROM {t} {a} WHERE {a}.{n} > :k GROUP BY {a}.{g}", "GROUP_BY_ALIAS", "", "GROUP_BY"),
    Template(
        "SELECT {a}.{g}, MIN({a}.{n}) AS low FROM {t} {a} GROUP BY {a}.{g} HAVING MIN({a}.{n}) < :k",
        "GROUP_BY_HAVING_ALIAS", "", "HAVING",
    ),
    Template("SELECT {x}, RANK() OVER (PARTITION BY {g} ORDER BY {n}) AS place FROM {t} WHERE {n} > :k", "WINDOW", "", "WINDOW"),
    Template('SELECT <include refid="{t}Fields"/> FROM {t} WHERE {n} > :k', "STATIC_INCLUDE_ONLY", "INCLUDE"),
    Template('SELECT <include refid="{t}Fields"/> FROM {t} <include refid="{t}Rest"/>', "MULTI_FRAGMENT_INCLUDE", "INCLUDE"),
    Template(
        'SELECT COUNT(*) FROM (SELECT {x} FROM {t} <where><if test="low != null">AND {n} > #{low}</if></where>) page',
        "IF_GUARDED_COUNT_WRAPPER", "IF,WHERE",
    ),
    Template(
        'SELECT {x} FROM {t} <where><if test="low != null">AND {n} > #{low}</if></where> ORDER BY ${by}',
        "IF_GUARDED_FILTER_STATEMENT", "IF,WHERE",
    ),
    Template(
        "SELECT {x} FROM {t} <where><choose><when test=\"kind != null\">{g} = #{kind}</when>"
        "<otherwise>{g} = ':s'</otherwise></choose></where>",
        "IF_GUARDED_FILTER_STATEMENT", "CHOOSE,WHERE",
    ),
    Template(
        'SELECT <include refid="{t}Fields"/> FROM {t} <where>{g} IN <foreach collection="kinds" item="one">#{one}</foreach>'
        '<if test="low != null">AND {n} > #{low}</if></where>',
        "FOREACH_COLLECTION_PREDICATE", "FOREACH,INCLUDE,IF,WHERE",
    ),
    Template('UPDATE {t} <set><if test="name != null">{x} = #{name},</if></set> WHERE id = #{id}', "UNKNOWN", "IF,SET", "NONE", ""),
    Template("SELECT {x}, <shown/> {n} FROM {t} WHERE {n} > :k", "UNKNOWN", "OPAQUE_XML"),
)
TEMPLATES = tuple(pattern.about(domain) for domain in DOMAINS for pattern in PATTERNS)
COUNT = len(TEMPLATES)


def _number(shift: int) -> Column:
    return ((F.col("o_orderkey") + shift) % COUNT).cast("int")


def _text(shift: int) -> Column:
    text = F.element_at(F.array(*[F.lit(t.text) for t in TEMPLATES]), _number(shift) + 1)
    text = F.replace(text, F.lit(":k"), F.col("o_orderkey").cast("string"))
    return F.replace(text, F.lit(":s"), F.col("o_orderstatus"))


def statements(orders: DataFrame, shift: int = 0) -> DataFrame:
    """``(sql_key, template_no, sql, o_orderkey)``, one row per order."""
    key = F.concat(F.lit("demo.s"), F.col("o_custkey").cast("string"), F.lit("#v"), F.col("o_orderkey").cast("string"))
    return orders.select(key.alias("sql_key"), _number(shift).alias("template_no"), _text(shift).alias("sql"), "o_orderkey")


def rewritten(orders: DataFrame, shift: int) -> DataFrame:
    """``(o_orderkey, template_no, original, rewritten)``: each statement beside the one ``shift`` templates on."""
    return orders.select(
        "o_orderkey", _number(0).alias("template_no"), _text(0).alias("original"), _text(shift).alias("rewritten")
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_sql(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def statements_sql(shift: int = 0) -> str:
    number = f"(o_orderkey + {shift}) % {COUNT}"
    return f"""SELECT concat('demo.s', o_custkey, '#v', o_orderkey) AS sql_key, o_orderkey,
  CAST({number} AS INTEGER) AS template_no, replace(replace(({list_sql(t.text for t in TEMPLATES)})[{number} + 1],
  ':k', CAST(o_orderkey AS VARCHAR)), ':s', o_orderstatus) AS sql FROM orders"""


def label_sql(field: str) -> str:
    """Label of a template by its number ``template_no``."""
    return f"({list_sql(getattr(t, field) for t in TEMPLATES)})[template_no + 1]"
