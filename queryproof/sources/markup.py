"""Markup to rows: statement mappers and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryproof.functions.text import strip

# Elements of a mapper that hold a statement or a fragment of one.
ELEMENTS = ("select", "insert", "update", "delete", "sql")
# An element of these, its attributes and its body up to the closing tag of the same name.
ELEMENT = rf"(?is)<({'|'.join(ELEMENTS)})(\s[^>]*)?(?<!/)>(.*?)</\1\s*>"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the text of a tag; the empty text where it has none."""
    quoted = F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


# The named entities of XML.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def without_xml_comments(text: Column) -> Column:
    """Comments left out, CDATA sections written as text with entities; what looks like either inside the other stays."""
    bare = F.regexp_replace(text, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")
    pieces = F.split(bare, r"<!\[CDATA\[|\]\]>")

    def plain(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.replace(F.replace(piece, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(piece)

    return F.when(F.contains(text, F.lit("<!")), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def decoded(text: Column) -> Column:
    """Entities as the characters they stand for: the five named ones, and numbers of either base."""
    pieces = F.split(text, "&#")

    def numbered(piece: Column, i: Column) -> Column:
        digits = F.regexp_extract(piece, r"(?s)^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits)
        char = F.decode(F.unhex(F.lpad(F.hex(code.try_cast("bigint")), 8, "0")), "UTF-32")
        rest = F.substring(piece, F.length(digits) + 2, F.length(piece))
        return F.when(i == 0, piece).when(digits == "", F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, rest))

    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, numbered), "")).otherwise(text)
    for name, char in ENTITIES.items():  # & comes last, so that nothing is decoded twice
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(namespace, element_id, element, body)`` of all statements and fragments of mapper files.

    Bodies mix text and tags, which row-tag readers cannot keep. The files are read as text cut at
    ``</mapper>``, so a record is one mapper, however large the files are, and large files are still
    split over tasks. Elements inside comments and CDATA sections are none; bodies are decoded.
    """
    mappers = spark.read.option("lineSep", "</mapper>").text(path).filter(F.col("value").contains("<mapper"))
    mappers = mappers.select(without_xml_comments(F.col("value")).alias("value"))
    root = F.regexp_extract("value", r"(?s)<mapper(\s[^>]*)>", 1)
    found = F.explode(F.regexp_extract_all("value", F.lit(ELEMENT), 0))
    rows = mappers.select(attribute(root, "namespace").alias("namespace"), found.alias("_whole"))
    return rows.select(
        "namespace",
        attribute(F.regexp_extract("_whole", ELEMENT, 2), "id").alias("element_id"),
        F.lower(F.regexp_extract("_whole", ELEMENT, 1)).alias("element"),
        decoded(strip(F.regexp_extract("_whole", ELEMENT, 3))).alias("body"),
    )


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``(namespace, statement_id, statement_type, body)`` of all statement elements."""
    rows = read_elements(spark, path).filter("element <> 'sql'")
    return rows.withColumnsRenamed({"element_id": "statement_id", "element": "statement_type"})


def include_edges(elements: DataFrame) -> DataFrame:
    """``(fragment, ref)``: which element includes which fragment, both as ``namespace.id``.

    An element without includes has one row with a NULL ``ref``; a reference without a namespace of its
    own is to the same mapper.
    """
    tags = F.regexp_extract_all("body", F.lit(r"(?is)(<include\s[^>]*>)"), 1)
    named = F.filter(F.transform(tags, lambda tag: attribute(tag, "refid")), lambda ref: ref != "")
    here = F.concat_ws(".", "namespace", "element_id")
    rows = elements.select(here.alias("fragment"), "namespace", F.explode_outer(F.array_distinct(named)).alias("ref"))
    whole = F.when(F.contains("ref", F.lit(".")), F.col("ref")).otherwise(F.concat_ws(".", "namespace", "ref"))
    return rows.select("fragment", F.when(F.col("ref").isNotNull(), whole).alias("ref"))


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements without mixed content through Spark's own XML source."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def mapper_document(namespace: Column, kind: Column, statement_id: Column, body: Column, note: Column | None = None) -> Column:
    """One mapper holding one statement and, if given, a comment before it, as text."""
    comment = F.lit("") if note is None else F.concat(F.lit("<!-- "), note, F.lit(" -->"))
    return F.concat(
        F.lit('<mapper namespace="'), namespace, F.lit('">'), comment, F.lit("<"), kind, F.lit(' id="'), statement_id,
        F.lit('">'), body, F.lit("</"), kind, F.lit("></mapper>"),
    )


def page_elements(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """``(key, pos, text)`` of the first group of a pattern, in page order."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "text"))
