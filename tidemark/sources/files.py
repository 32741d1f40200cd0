"""Files of records as tables: JSON lines, CSV, and sinks of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under ``path`` with the columns of ``schema``; a line that is no JSON gives a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, columns by name; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def open_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table under ``path``; an empty one with ``schema`` is written first where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def record_set(column: str | Column, element: str) -> Column:
    """A JSON array in a text column as an array of ``element`` (a type); empty where it is null or no such array."""
    return F.coalesce(F.from_json(column, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def bounded(value: int, low: int, high: int) -> int:
    """``value`` if it lies between the bounds, ends included; else an error."""
    if not low <= value <= high:
        raise ValueError(f"{value} is not between {low} and {high}")
    return value
