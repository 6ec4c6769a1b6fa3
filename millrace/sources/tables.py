"""The standard parquet tables, with time-zone-free timestamps cast once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, restricted to ``columns`` if given; ``timestamp_ntz`` becomes ``timestamp``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    casts = {
        field.name: F.col(field.name).cast("timestamp")
        for field in df.schema
        if isinstance(field.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df
