"""Sources and sinks: round trips through shared scratch space, metadata and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.operators.closure import reference_closure
from queryproof.operators.joins import not_exists_in
from queryproof.plans import corpus
from queryproof.plans.registry import query
from queryproof.sources import catalog, contracts, jsonl, markup

ORDER_TEXT_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority "
    "FROM orders"
)


def _shown(df):
    return df.drop(jsonl.CORRUPT).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("io_jsonl_read", ORDER_TEXT_SQL)
def io_jsonl_read(t):
    """Orders written as JSON lines and read back, together with a path that holds nothing."""
    path = t.scratch("io_jsonl_read")
    jsonl.write_jsonl(t.orders, path)
    there = jsonl.read_jsonl(t.spark, path, t.orders.schema)
    missing = jsonl.read_jsonl(t.spark, f"{path}-missing", t.orders.schema)
    return _shown(there.unionByName(missing))


@query("io_jsonl_write", f"{ORDER_TEXT_SQL} WHERE o_orderstatus IN ('F', 'O')")
def io_jsonl_write(t):
    """Overwrite replaces, append adds."""
    path = t.scratch("io_jsonl_write")
    status = F.col("o_orderstatus")
    jsonl.write_jsonl(t.orders.filter(status == "P"), path)
    jsonl.write_jsonl(t.orders.filter(status == "F"), path)
    jsonl.write_jsonl(t.orders.filter(status == "O"), path, append=True)
    return _shown(jsonl.read_jsonl(t.spark, path, t.orders.schema))


@query(
    "io_xml_statements",
    f"""
WITH s AS ({corpus.statements_sql()})
SELECT split_part(sql_key, '#', 1) AS namespace, split_part(sql_key, '#', 2) AS statement_id,
  CASE WHEN starts_with(sql, 'UPDATE') THEN 'update' ELSE 'select' END AS statement_type, md5(sql) AS body_digest FROM s""",
)
def io_xml_statements(t):
    """The statement corpus written as mapper documents and read back, markup inside bodies kept.

    A third of the bodies stand in CDATA sections, a third with entities for quotes, equals signs and comparisons; each
    mapper has a statement that is commented out.
    """
    path = t.scratch("io_xml_statements")
    s = corpus.statements(t.orders)
    parts = F.split("sql_key", "#")
    kind = F.when(F.col("sql").startswith("UPDATE"), "update").otherwise("select")
    number = F.pmod(F.xxhash64("sql_key"), F.lit(3))
    escaped = F.replace(F.replace(F.replace(F.col("sql"), F.lit("'"), F.lit("&apos;")), F.lit("="), F.lit("&#61;")), F.lit(","), F.lit("&#x2c;"))
    body = F.when(number == 0, F.concat(F.lit("<![CDATA["), F.col("sql"), F.lit("]]>"))).when(number == 1, escaped).otherwise(F.col("sql"))
    note = F.lit('<select id="old">SELECT 1</select>')
    s.select(markup.mapper_document(parts[0], kind, parts[1], body, note)).write.text(path)
    return markup.read_statements(t.spark, path).select(
        "namespace", "statement_id", "statement_type", F.md5("body").alias("body_digest")
    )


_MAPPER = """<mapper namespace="m{k}">
<sql id="Tail"> ORDER BY id </sql>
<sql id="Fields">id, <include refid="Extra"/> name</sql>
<select id="all">SELECT <include refid="Fields" /> FROM parts{k} <include refid="Tail"></include></select>
<update id="one">UPDATE parts{k} SET name = #{{name}} WHERE id = {k}</update>
<select id="far">SELECT <include refid="m{far}.Fields"/> FROM parts</select>
</mapper>
"""


def _mapper_edges(t):
    """Mapper files of three statements and two fragments per part, one fragment missing everywhere."""
    path = t.scratch("io_mapper_files")
    pieces = []
    for i, piece in enumerate(_MAPPER.replace("{{", "{").replace("}}", "}").split("{k}")):
        pieces += [F.col("p_partkey").cast("string")] if i else []
        for j, text in enumerate(piece.split("{far}")):
            pieces += [(F.col("p_partkey") + 1).cast("string")] if j else []
            pieces.append(F.lit(text))
    t.part.select(F.concat(*pieces)).write.text(path)
    return markup.include_edges(markup.read_elements(t.spark, path))


_INCLUDES_SQL = """
e AS (SELECT 'm' || p_partkey || '.' || id AS fragment,
        CASE WHEN to_far THEN 'm' || (p_partkey + 1) || '.Fields' ELSE 'm' || p_partkey || '.' || target END AS ref
      FROM part, (VALUES ('Tail', NULL, false), ('Fields', 'Extra', false), ('all', 'Fields', false),
        ('all', 'Tail', false), ('one', NULL, false), ('far', NULL, true)) v(id, target, to_far))"""


@query("io_include_edges", f"WITH {_INCLUDES_SQL} SELECT fragment, ref FROM e")
def io_include_edges(t):
    return _mapper_edges(t)


@query(
    "io_unresolved_includes",
    f"WITH {_INCLUDES_SQL} SELECT fragment, ref FROM e WHERE ref IS NOT NULL AND ref NOT IN (SELECT fragment FROM e)",
)
def io_unresolved_includes(t):
    edges = _mapper_edges(t)
    return not_exists_in(edges.filter("ref IS NOT NULL"), "ref", edges.select("fragment").distinct(), "fragment")


@query(
    "io_include_closure",
    f"""
WITH RECURSIVE {_INCLUDES_SQL},
w AS (SELECT fragment AS root, ref, 0 AS level FROM e WHERE ref IS NOT NULL
      UNION SELECT root, e.ref, level + 1 FROM w JOIN e ON e.fragment = w.ref WHERE e.ref IS NOT NULL),
c AS (SELECT root, count(DISTINCT ref) AS n_refs, CAST(max(level) AS INTEGER) AS max_level FROM w GROUP BY root)
SELECT DISTINCT fragment AS root, coalesce(n_refs, 0) AS n_refs, max_level, false AS degraded
FROM e LEFT JOIN c ON root = fragment""",
)
def io_include_closure(t):
    edges = _mapper_edges(t)
    return reference_closure(edges.select(F.col("fragment").alias("root")).distinct(), edges, t.scratch("includes"))


@query("io_xml_rows", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def io_xml_rows(t):
    """Plain elements through the built-in XML source, with a given schema."""
    path = t.scratch("io_xml_rows")
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.format("xml").option("rowTag", "part").option("rootTag", "parts").save(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields)
    return markup.read_xml_rows(t.spark, path, "part", schema)


@query(
    "io_html_pages",
    """
WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS found FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, found[i] AS text FROM p, unnest(range(1, len(found) + 1)) x(i)""",
)
def io_html_pages(t):
    return markup.page_elements(t.pages, "page_id", "html", '<li><a href="[^"]*">([^<]*)</a></li>')


@query(
    "io_catalog_partitioned",
    "SELECT o_orderstatus, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders "
    "GROUP BY o_orderstatus",
)
def io_catalog_partitioned(t):
    path = t.scratch("io_catalog_partitioned")
    catalog.write_catalog(t.orders, path, ["o_orderstatus"])
    return catalog.catalog_index(catalog.read_catalog(t.spark, path), ["o_orderstatus"], "o_orderkey")


METADATA_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]
TYPES_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"""


@query(
    "io_table_metadata",
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in METADATA_TABLES)
    + f""")
SELECT c.table_name, r.n_rows, CAST(ordinal_position AS INTEGER) AS position, column_name, {TYPES_SQL} AS data_type, true AS nullable,
  CAST(0 AS BIGINT) AS n_null FROM information_schema.columns c JOIN r ON r.table_name = c.table_name""",
)
def io_table_metadata(t):
    return reduce(DataFrame.unionByName, [catalog.table_metadata(n, t.read(n)) for n in METADATA_TABLES])


_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query(
    "io_column_cardinality",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in _LINEITEM
    ),
)
def io_column_cardinality(t):
    """Exact distinct values of every column."""
    found = catalog.table_metadata("lineitem", t.lineitem.select(*_LINEITEM), distinct="exact")
    return found.select("column_name", "n_rows", "n_null", "n_distinct")


def order_contract():
    return contracts.Contract(
        required=["o_orderkey", "o_custkey", "o_orderpriority"],
        enums={"o_orderstatus": ["F", "O"]},
        checks={"RANGE:o_totalprice": F.col("o_totalprice") < 450000},
    )


@query(
    "io_contract_validate",
    """
WITH o AS (SELECT o_orderkey, nullif(o_custkey, 7) AS c, nullif(o_orderpriority, '5-LOW') AS p, o_orderstatus AS s, o_totalprice AS t FROM orders),
x AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN c IS NULL THEN 'MISSING:o_custkey' END, CASE WHEN p IS NULL THEN
  'MISSING:o_orderpriority' END, CASE WHEN s NOT IN ('F', 'O') THEN 'ENUM:o_orderstatus' END,
  CASE WHEN t >= 450000 THEN 'RANGE:o_totalprice' END, CASE WHEN c IS NOT NULL AND p IS NOT NULL AND s IN ('F', 'O') AND t < 450000
  THEN 'VALID' END], lambda v: v IS NOT NULL)) AS code FROM o)
SELECT code, count(*) AS n FROM x GROUP BY code""",
)
def io_contract_validate(t):
    return contracts.violation_counts(_broken_orders(t), order_contract())


def _broken_orders(t):
    return t.orders.withColumns(
        {
            "o_custkey": F.nullif(F.col("o_custkey"), F.lit(7)),
            "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
        }
    )


@query(
    "io_contract_quarantine",
    """
WITH o AS (SELECT o_orderkey, o_custkey <> 7 AND o_orderpriority <> '5-LOW' AND o_orderstatus IN ('F', 'O') AND o_totalprice < 450000
  AS valid FROM orders) SELECT CASE WHEN valid THEN 'valid' ELSE 'quarantine' END AS target, count(*) AS n, min(o_orderkey) AS first_key
FROM o GROUP BY ALL""",
)
def io_contract_quarantine(t):
    valid, broken = contracts.split_by_contract(_broken_orders(t), order_contract())
    both = valid.select(F.lit("valid").alias("target"), "o_orderkey").unionAll(
        broken.select(F.lit("quarantine"), "o_orderkey")
    )
    return both.groupBy("target").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    "rp_contract_enum",
    """
WITH e AS (SELECT CASE WHEN user_id % 10 = 3 THEN 'not json' WHEN user_id % 10 = 4 THEN '{"k": 1, "extra": 2}' ELSE props END AS props,
  event_type FROM events),
x AS (SELECT unnest(list_filter([CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') THEN 'ENUM:event_type' END,
  CASE WHEN props = 'not json' THEN 'NOT_JSON:props' END, CASE WHEN contains(props, 'extra') THEN 'UNEXPECTED:props' END,
  CASE WHEN event_type <> 'error' AND props <> 'not json' AND NOT contains(props, 'extra') THEN 'VALID' END],
  lambda v: v IS NOT NULL)) AS code FROM e)
SELECT code, count(*) AS n FROM x GROUP BY code""",
)
def rp_contract_enum(t):
    tail = F.col("user_id") % 10
    props = F.when(tail == 3, "not json").when(tail == 4, '{"k": 1, "extra": 2}').otherwise(F.col("props"))
    contract = contracts.Contract(
        required=["event_id", "ts"],
        enums={"event_type": ["click", "view", "signup", "purchase"]},
        json_keys={"props": ["k"]},
    )
    return contracts.violation_counts(t.events.withColumn("props", props), contract)
