"""Schemas at operator borders, null checks, expected grids, set operations on keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F, types as T

from tidemark.functions.ladder import floor_to_bar, start_of_bar
from tidemark.functions.scalars import drawn
from tidemark.operators.blocks import BLOCK_BARS, filled, framed, numbered

CANDLES = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("timeframe", T.StringType(), False),
        T.StructField("date", T.TimestampNTZType(), False),
        *[T.StructField(c, T.DoubleType(), False) for c in ("open", "high", "low", "close", "volume")],
    ]
)
CANDLES_ATR = T.StructType(
    [*CANDLES.fields, T.StructField("atr", T.DoubleType()), T.StructField("volume_rma", T.DoubleType())]
)


class SchemaError(ValueError):
    """A frame does not have the columns, types or values its schema asks for."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here; Spark orders it above all numbers, so it becomes NULL at the border."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Cast to the schema's types, in its order; other columns are dropped when strict, else kept at the end."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    named = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    rest = [] if strict else [c for c in df.columns if c not in schema.names]
    return nan_to_null(df.select(*named, *rest))


def null_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns the schema does not allow NULL in that have some; one pass over the data."""
    asked = [f.name for f in schema if not f.nullable and f.name in df.columns]
    if not asked:
        return []
    row = df.agg(*[F.max(is_missing(df, c)).alias(c) for c in asked]).first()
    return [c for c in asked if row[c]]


def is_missing(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def checked(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """`conform`, and an error when a column that must not be NULL is."""
    out = conform(df, schema, strict)
    bad = null_columns(out, schema)
    if bad:
        raise SchemaError(f"NULL in {bad}")
    return out


def with_schemas(result: T.StructType | None = None, **arguments: T.StructType) -> Callable:
    """Decorator: conform the named DataFrame arguments, and the result, to their schemas."""

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args, **kwargs):
            names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
            bound = {**dict(zip(names, args, strict=False)), **kwargs}
            for name, schema in arguments.items():
                bound[name] = conform(bound[name], schema, strict=False)
            out = fn(**bound)
            return conform(out, result) if result is not None else out

        return run

    return wrap


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def reject_timeframe(df: DataFrame) -> DataFrame:
    """For operators on one timeframe: a frame that has the key is a mistake."""
    if "timeframe" in df.columns:
        raise SchemaError("a single-timeframe frame must not have a timeframe column")
    return df


def one_timeframe(df: DataFrame, tf: str, keep: bool = False) -> DataFrame:
    """The rows of one timeframe, without the key unless `keep`."""
    rows = df.where(F.col("timeframe") == tf)
    return rows if keep else rows.drop("timeframe")


def trim(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the closed range."""
    return df.where(F.col("date").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise SchemaError(f"duplicate keys {list(keys)}")
    return df


def last_complete_rows(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """The last `n` rows of each series that have no NULL; series with fewer have too little data and give none."""
    whole = df.dropna()
    rows = numbered(whole, keys, (order,), name="_n")
    sizes = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(sizes, list(keys)).where((F.col("_size") >= n) & (F.col("_n") >= F.col("_size") - n)).drop("_n", "_size")


def common_complete_range(frames: dict[str, DataFrame], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series the range in which every frame is complete: latest first row to earliest last row."""
    bounds = None
    for df in frames.values():
        b = df.dropna().groupBy(*keys).agg(F.min("date").alias("start"), F.max("date").alias("end"))
        bounds = b if bounds is None else bounds.unionByName(b)
    return (
        bounds.groupBy(*keys)
        .agg(F.max("start").alias("start"), F.min("end").alias("end"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") == len(frames)) & (F.col("start") <= F.col("end")))
        .drop("_n")
    )


def expected_grid(bounds: DataFrame, tf: str, size: int = BLOCK_BARS) -> DataFrame:
    """Every bar number from `first` to `last` of each row of `bounds`; blocks first, then the bars of a block."""
    blocks = bounds.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("first") / size).cast("long"), F.floor(F.col("last") / size).cast("long")))
    )
    keys = [c for c in bounds.columns if c not in ("first", "last")]
    bars = F.explode(
        F.sequence(F.greatest("first", F.col("_block") * size), F.least("last", F.col("_block") * size + size - 1))
    )
    return blocks.repartition(*keys, "_block").withColumn("bar", bars).select(*keys, "bar", start_of_bar("bar", tf).alias("date"))


def missing_bars(df: DataFrame, tf: str, bounds: DataFrame | None = None) -> DataFrame:
    """Bars of the grid that a series lacks. Nothing fails on them; they are rows like others."""
    if bounds is None:
        bounds = df.groupBy("symbol").agg(F.min("bar").alias("first"), F.max("bar").alias("last"))
    return expected_grid(bounds, tf).join(df.select("symbol", "bar"), ["symbol", "bar"], "left_anti")


def excess_rows(df: DataFrame, tf: str) -> DataFrame:
    """Rows whose date is no bar start."""
    return df.where(F.col("date") != floor_to_bar("date", tf))


def gap_runs(missing: DataFrame, tf: str, size: int = BLOCK_BARS) -> DataFrame:
    """Runs of missing bars as `(symbol, start, end, bars)`.

    A run starts where the bar before is not missing and ends where the one after is not: one pass over blocks of bars tells. Only those
    rows go on, and a run's start is carried forward to its end, so a long run is never gathered in one place.
    """
    def edges(rows: DataFrame, w: WindowSpec) -> DataFrame:
        opens = F.coalesce(F.lag("bar").over(w) != F.col("bar") - 1, F.lit(True))
        closes = F.coalesce(F.lead("bar").over(w) != F.col("bar") + 1, F.lit(True))
        return rows.withColumns({"first": F.when(opens, F.col("bar")), "_closes": closes})

    flagged = framed(missing.select("symbol", "bar", "date"), edges, before=1, after=1, keys=("symbol",), size=size)
    runs = filled(flagged.where("first IS NOT NULL OR _closes"), ["first"], keys=("symbol",)).where("_closes")
    return runs.select(
        "symbol", start_of_bar("first", tf).alias("start"), start_of_bar("bar", tf).alias("end"),
        (F.col("bar") - F.col("first") + 1).alias("bars"),
    )


def keys_outside(df: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the valid ones."""
    return df.join(valid.select(*keys), list(keys), "left_anti")


def mapped_symbols(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename symbols by a table `(symbol, name)`; symbols it lacks keep theirs."""
    return (
        df.join(mapping.withColumnRenamed("name", "_name"), "symbol", "left")
        .withColumn("symbol", F.coalesce("_name", "symbol"))
        .select(*df.columns)
    )


def with_random_gaps(df: DataFrame, tf: str, per_series: int, longest: int, seed: int) -> DataFrame:
    """Take out `per_series` runs of up to `longest` bars of each series, the same ones for the same seed.

    Each run lies in its own slice of the series, so runs never overlap and a row needs only its slice to know.
    """
    bounds = df.groupBy("symbol").agg(F.min("bar").alias("_first"), F.max("bar").alias("_last"))
    slice_width = F.greatest(F.lit(longest + 1), F.ceil((F.col("_last") - F.col("_first") + 1) / per_series))
    rows = df.join(bounds, "symbol").withColumns({"_width": slice_width})
    rows = rows.withColumn("_slice", F.floor((F.col("bar") - F.col("_first")) / F.col("_width")))
    length = drawn("symbol", "_slice", F.lit(seed)) % longest + 1
    offset = drawn("symbol", "_slice", F.lit(seed), part=1) % (F.col("_width") - length)
    place = F.pmod(F.col("bar") - F.col("_first"), F.col("_width"))
    return rows.where((place < offset) | (place >= offset + length)).select(*df.columns)


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by name; columns only one side has are NULL on the other."""
    return left.unionByName(right, allowMissingColumns=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def min_max_scaled(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Columns moved to -1 … 1 by their least and greatest value in each series."""
    ends = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    return df.join(ends, list(keys)).withColumns(
        {c: F.try_divide(2 * (F.col(c) - F.col(f"_lo_{c}")), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) - 1 for c in columns}
    ).select(*df.columns)
