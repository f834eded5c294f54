"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                **options) -> DataFrame:
    """A4: newline-delimited JSON; the schema is inferred unless given
    (give it in production: inference is an extra pass over the data)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.options(**options).json(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """One JSON record per line."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_survey_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    header: bool = True, **options) -> DataFrame:
    """CSV with a header row; typed by ``schema`` (no inference pass)."""
    r = spark.read.option("header", str(header).lower())
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true")
    return r.options(**options).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """Table to CSV files with a header."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)
