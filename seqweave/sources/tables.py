"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def typed(df: DataFrame) -> DataFrame:
    """Widen every integer to BIGINT and every real to DOUBLE, the types results are published in."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)
