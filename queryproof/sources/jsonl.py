"""JSON lines: explicit schemas, append or overwrite, missing input means no rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Keeps microseconds of timestamps without a zone.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines files; lines that do not parse keep their text in ``_corrupt_record``.

    The schema is always given: inferring it would read everything twice and let types drift.
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
    )
    try:
        return reader.json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], full)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line; NULL fields are kept so that every line shows every field."""
    (
        df.write.mode("append" if append else "overwrite")
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("ignoreNullFields", "false")
        .json(path)
    )
