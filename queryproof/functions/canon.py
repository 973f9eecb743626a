"""Canonical row text and row hashes.

Two rows have the same canonical text exactly when they are equal value by value: strings carry
their length, NULL has its own mark, maps are sorted by key and ``-0.0`` equals ``0.0``.

Expressions are written as SQL text: one parse per row expression instead of many small calls from
Python to the JVM, which matters when hundreds of query pairs are compared in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scalar_text_sql(x: str, dtype: T.DataType) -> str:
    """Text of a value that is neither a string nor nested; NULL for NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CAST({x} + CAST(0 AS {dtype.simpleString()}) AS STRING)"
    if isinstance(dtype, T.BinaryType):
        return f"hex({x})"
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({x}) AS STRING)"
    return f"CAST({x} AS STRING)"


def value_text_sql(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """Canonical text of one value; never NULL."""
    v = f"v{depth}"
    if isinstance(dtype, STRINGS):
        text = f"concat('S', CAST(length({x}) AS STRING), ':', {x})"
    elif isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, PLAIN):
            # the same text without a lambda, which Spark interprets: no text of these types holds a '|' or '#'
            joined = f"concat('|V', array_join(CAST({x} AS ARRAY<STRING>), '|V', '#'))"
            text = f"CASE WHEN size({x}) = 0 THEN '[]' ELSE concat('[', substring(replace({joined}, '|V#', '|N'), 2), ']') END"
        else:
            item = value_text_sql(v, dtype.elementType, depth + 1)
            text = f"concat('[', array_join(transform({x}, {v} -> {item}), '|'), ']')"
    elif isinstance(dtype, T.MapType):
        key = value_text_sql(f"{v}.key", dtype.keyType, depth + 1)
        value = value_text_sql(f"{v}.value", dtype.valueType, depth + 1)
        entries = f"transform(map_entries({x}), {v} -> concat({key}, '=', {value}))"
        text = f"concat('{{', array_join(sort_array({entries}), '|'), '}}')"
    elif isinstance(dtype, T.StructType):
        fields = [value_text_sql(f"{x}.{quoted(f.name)}", f.dataType, depth + 1) for f in dtype.fields]
        text = f"concat('(', concat_ws('|', {', '.join(fields)}), ')')"
    else:
        text = f"concat('V', {scalar_text_sql(x, dtype)})"
    return f"CASE WHEN {x} IS NULL THEN 'N' ELSE {text} END"


def row_text_sql(schema: T.StructType, columns: Sequence[str] | None = None) -> str:
    """Canonical text of a whole row as one concatenation, which builds it in a single buffer."""
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for i, name in enumerate(columns or schema.names):
        x, dtype, sep = quoted(name), types[name], "|" if i else ""
        if isinstance(dtype, NESTED):
            parts += [f"'{sep}'", value_text_sql(x, dtype)]
            continue
        kind = "S" if isinstance(dtype, STRINGS) else "V"
        parts.append(f"CASE WHEN {x} IS NULL THEN '{sep}N' ELSE '{sep}{kind}' END")
        if kind == "S":
            parts += [f"coalesce(concat(CAST(length({x}) AS STRING), ':'), '')", f"coalesce({x}, '')"]
        else:
            parts.append(f"coalesce({scalar_text_sql(x, dtype)}, '')")
    return f"concat({', '.join(parts)})"


def native_hash_sql(schema: T.StructType, columns: Sequence[str], salt: int = 0) -> str:
    """xxhash64 skips NULLs, so their pattern is hashed as well; nested values go in as text."""
    types = {f.name: f.dataType for f in schema.fields}
    values = [value_text_sql(quoted(n), types[n]) if isinstance(types[n], NESTED) else quoted(n) for n in columns]
    nulls = [f"CASE WHEN {quoted(n)} IS NULL THEN '1' ELSE '0' END" for n in columns]
    return f"xxhash64({salt}, {', '.join(values)}, concat({', '.join(nulls)}))"


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical text of a row, columns in the given order."""
    return F.expr(row_text_sql(df.schema, columns))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "native") -> Column:
    """Row hash as BIGINT.

    ``md5``: 60 bits of the MD5 of the canonical text; any SQL engine can recompute it.
    ``native``: xxhash64 over the typed columns and their NULL pattern, several times faster.
    """
    schema = df.schema
    if algorithm == "native":
        return F.expr(native_hash_sql(schema, columns or schema.names))
    if algorithm != "md5":
        raise ValueError(f"unknown row hash algorithm: {algorithm}")
    return F.expr(f"CAST(conv(substring(md5({row_text_sql(schema, columns)}), 1, 15), 16, 10) AS BIGINT)")


def row_digest(df: DataFrame) -> Column:
    """128 bits of two native hashes, for grouping equal rows without moving them."""
    schema = df.schema
    first, second = (native_hash_sql(schema, schema.names, salt) for salt in (0, 1))
    return F.expr(f"named_struct('a', {first}, 'b', {second})")
