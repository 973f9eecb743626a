import pytest
from pyspark.sql.types import StructType


@pytest.fixture(scope="session")
def rows_of(spark):
    """A DataFrame of rows, with columns whose names clash with what operators use inside."""

    def make(ddl, rows, clash=True):
        schema = StructType.fromDDL(ddl)
        df = spark.createDataFrame(rows, schema)
        if clash:
            for name in ("id", "key", "size", "node", "score", "kinds", "ids", "media", "n", "_id", "_digest", "bucket"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
