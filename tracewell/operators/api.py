"""What callers of the operations get besides tables: the health row, and an error for what isn't there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"


class NotFoundError(LookupError):
    """What was asked for does not exist."""


def health(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """ok, the version, and the number of rows of each table given; empty if one of them has none."""
    out = spark.createDataFrame([("ok", VERSION)], "status string, version string")
    for name, df in tables.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)), F.lit(True))
    return out.withColumn("status", F.when(F.least(*[F.col(x) for x in tables], F.lit(1), F.lit(1)) > 0, F.col("status")).otherwise("empty"))


def found(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row: for lookups of one trace or rule."""
    if df.isEmpty():
        raise NotFoundError(f"{what} not found")
    return df
