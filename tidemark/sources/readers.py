"""Scans: Parquet ranges, raw candle rows, CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.clock import from_epoch_us
from tidemark.operators.validate import CANDLES, conform


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_range(
    spark: SparkSession, paths: Sequence[str], start: str, end: str, time: str = "date", schema: T.StructType | None = None
) -> DataFrame:
    """Rows of many Parquet files within the closed range. The time column is compared as stored, so the filter
    reaches the files' row groups."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(*paths)
    stored = rows.schema[time].dataType
    return rows.where(F.col(time).between(F.lit(start).cast(stored), F.lit(end).cast(stored)))


def raw_to_candles(raw: DataFrame, tf: str) -> DataFrame:
    """Raw rows `(symbol, epoch milliseconds, open, high, low, close, volume)` as typed candles."""
    out = raw.withColumns({"date": from_epoch_us(F.col("ms") * 1000), "timeframe": F.lit(tf)})
    return conform(out, CANDLES)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; values that do not parse become NULL and are for the null check to find."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_any(spark: SparkSession, stem: str, schema: T.StructType) -> DataFrame:
    """`stem.parquet` or `stem.csv`, the first that exists."""
    if exists(spark, f"{stem}.parquet"):
        return conform(spark.read.parquet(f"{stem}.parquet"), schema)
    if exists(spark, f"{stem}.csv"):
        return read_csv(spark, f"{stem}.csv", schema)
    raise FileNotFoundError(stem)
