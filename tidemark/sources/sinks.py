"""Writes: checked tables, windowed tables that fill their own gaps, sample batches, compaction and rewriting by versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.ladder import bar_of, start_of_bar
from tidemark.operators.validate import SchemaError, conform, null_columns
from tidemark.session import staged
from tidemark.sources.manifest import FREQUENCIES, merge_batches, require_whole_windows, window_coverage
from tidemark.sources.readers import exists

#: Rows of the windows in a table (symbol if there are symbols, window, start, end), `end` excluded. Other rows are left out.
Generator = Callable[[SparkSession, DataFrame], DataFrame]


def utc_now() -> datetime:
    """Now in UTC, without a zone, as dates are stored."""
    return datetime.now(UTC).replace(tzinfo=None)


def write_checked(
    df: DataFrame, path: str, schema: T.StructType, partition_by: Sequence[str] = ("timeframe",),
    nulls_allowed: bool = False, mode: str = "overwrite",
) -> DataFrame:
    """Write a table in its schema, ZSTD-compressed; an error, and nothing written, on NULL where there may be none."""
    out = conform(df, schema, strict=False)
    if not nulls_allowed:
        out = staged(out)
        bad = null_columns(out, schema)
        if bad:
            raise SchemaError(f"NULL in {bad}; nothing was written")
    out.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return out.sparkSession.read.schema(out.schema).parquet(path)


def write_batches(samples: DataFrame, path: str, rows_per_file: int) -> None:
    """Training samples with their array columns, a bounded number per file."""
    samples.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


# Datasets whose rows need later bars to be final: how long after its end a window may be stored.
MATURITY: dict[str, timedelta] = {}


def register_maturity(dataset: str, wait: timedelta) -> None:
    """Rows of `dataset` look ahead by `wait`; its windows are stored that much later."""
    MATURITY[dataset] = wait


def read_or_generate(
    spark: SparkSession, table: str, dataset: str, start: datetime, end: datetime, generate: Generator,
    schema: T.StructType, freq: str = "D", now: datetime | None = None,
    after_read: Callable[[DataFrame], DataFrame] | None = None, series: DataFrame | None = None,
    timeframes: Sequence[str] = (), not_null: Sequence[str] = (),
) -> DataFrame:
    """Rows of a closed range from a windowed table; windows it lacks are generated, and stored once they are over.

    A window is known per symbol: `series` (column symbol) names the symbols asked for, and is needed if the table has
    symbols. `generate(spark, missing)` is given the missing windows as a table and is called once for all windows that are over, and once for
    those that are not. Windows that are still open, or whose rows still wait for later bars, are generated for this read and not stored.

    Each write is a run of its own. Its rows are checked as written, and count only once the run's marks are there, one per
    symbol and window, empty windows included; so a failed run leaves its windows missing, and an empty window is asked for
    once. The latest mark of a window wins.

    With `timeframes`, a stored window must have rows of all of them or of none: others raise before anything is
    written. Rows in which a column of `not_null` is NULL count as not there, and windows of only such rows are made again.
    """
    tf = FREQUENCIES[freq]
    keys = ["symbol"] if "symbol" in schema.names else []
    if keys and series is None:
        raise ValueError("a table with symbols needs the series that are asked for")
    final = (now or utc_now()) - MATURITY.get(dataset, timedelta())
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    source = series.select(*keys).distinct() if keys else spark.range(1)
    asked = source.select(*keys, F.explode(F.sequence(bar_of(first, tf), bar_of(last, tf))).alias("window"))
    known = _latest_marks(spark, table, keys)
    missing = asked.join(known, [*keys, "window"], "left_anti")
    if timeframes:
        held = asked.join(known.where("rows > 0"), [*keys, "window"])
        state = window_coverage(_stored(spark, table, schema, held), held.select(*keys, "window"), timeframes, freq, not_null)
        unusable = require_whole_windows(state).where("state = 'missing'").select(*keys, "window")
        missing = missing.unionByName(unusable)
    missing = missing.withColumns({"start": start_of_bar("window", tf), "end": start_of_bar(F.col("window") + 1, tf)})
    missing = staged(missing.withColumn("_over", F.col("end") <= F.lit(final).cast("timestamp_ntz")))
    # two numbers: how many windows are over, and how many are not
    over, still_open = missing.agg(F.count_if("_over"), F.count_if(~F.col("_over"))).first()

    def made(windows: DataFrame) -> DataFrame:
        rows = conform(generate(spark, windows.drop("_over")), schema).withColumn("window", bar_of("date", tf))
        return rows.join(windows.select(*keys, "window"), [*keys, "window"], "left_semi")

    if over:
        windows = missing.where("_over")
        _store(table, made(windows), windows.select(*keys, "window"), schema, keys)
    wanted = asked.join(_latest_marks(spark, table, keys), [*keys, "window"])
    out = _stored(spark, table, schema, wanted).where(F.col("window").between(bar_of(first, tf), bar_of(last, tf)))
    if still_open:
        out = out.unionByName(made(missing.where("NOT _over")).select(*out.columns))
    out = out.where(F.col("date").between(first, last)).drop("window")
    return after_read(out) if after_read else out


def rewritten(spark: SparkSession, table: str, schema: T.StructType, column: str, value: Column) -> int:
    """Store the windows of a table in which `value` differs from `column` anew, with `value` instead; how many there were.

    Rows are written as a run of their own, and its marks take the place of the old ones when they are there: a reader sees a
    window as it was or as it is now. Old rows stay until the shared folder lets go of them.
    """
    keys = ["symbol"] if "symbol" in schema.names else []
    rows = _stored(spark, table, schema, _latest_marks(spark, table, keys))
    stale = staged(rows.where(~F.col(column).eqNullSafe(value)).select(*keys, "window").distinct())
    n = stale.count()
    if n:
        fresh = rows.join(stale, [*keys, "window"], "left_semi").withColumn(column, value)
        _store(table, fresh, stale, schema, keys)
    return n


def _marks_of(table: str) -> str:
    return f"{table.rstrip('/')}.windows"


def _latest_marks(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The run that holds each known window, and how many rows it has: `(symbol, window, run, rows)`."""
    names = ", ".join([*[f"{k} string" for k in keys], "window long, run string, rows long"])
    if not exists(spark, _marks_of(table)):
        return spark.createDataFrame([], names)
    marks = spark.read.schema(names).parquet(_marks_of(table))
    return marks.groupBy(*keys, "window").agg(F.max(F.struct("run", "rows")).alias("_m")).select(*keys, "window", "_m.*")


def _stored(spark: SparkSession, table: str, schema: T.StructType, marks: DataFrame) -> DataFrame:
    """Rows of the windows that `marks` lists, with their window."""
    columns = [f for f in T.StructType([*schema.fields, T.StructField("window", T.LongType())])]
    if not exists(spark, table):
        return spark.createDataFrame([], T.StructType(columns))
    rows = spark.read.schema(T.StructType([*columns, T.StructField("run", T.StringType())])).parquet(table)
    names = [c for c in ("symbol", "window", "run") if c in marks.columns]
    return rows.join(marks.select(*names), names, "left_semi").select(*[f.name for f in columns])


def _store(table: str, rows: DataFrame, windows: DataFrame, schema: T.StructType, keys: list[str]) -> None:
    """Write rows as a run, check what was written, then mark all `windows` as known."""
    spark, run = rows.sparkSession, f"r{utc_now():%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
    out = rows.select(*schema.names, "window").withColumn("run", F.lit(run))
    out.write.mode("append").option("compression", "zstd").partitionBy("run", "window").parquet(table)
    written = spark.read.schema(out.schema).parquet(table).where(F.col("run") == run)
    bad = null_columns(written, schema)
    if bad:
        raise SchemaError(f"NULL in {bad}; the windows stay missing")
    sizes = written.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("rows"))
    marks = windows.join(sizes, [*keys, "window"], "left")
    marks.select(*keys, "window", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0)).alias("rows")).write.mode("append").parquet(_marks_of(table))


def read_or_generate_one(
    spark: SparkSession, path: str, start: datetime, end: datetime, generate: Generator, schema: T.StructType,
    now: datetime | None = None, empty_allowed: bool = False,
) -> DataFrame:
    """One stored result for one range: read it if it is there, else generate, check and, once over, store it."""
    if exists(spark, path):
        return conform(spark.read.parquet(path), schema)
    rows = staged(conform(generate(spark, start, end), schema))
    if not empty_allowed and rows.isEmpty():
        raise ValueError("the generated result is empty")
    if end >= (now or utc_now()):
        return rows
    bad = null_columns(rows, schema)
    if bad:
        raise SchemaError(f"NULL in {bad}; nothing was written")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def manifest_of(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Manifest of the files `<symbol>.<dataset>.<range>.parquet` under a folder, from their listing alone."""
    from tidemark.functions.scalars import range_end, range_start, with_file_info

    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", True
    ).load(root).select("path", F.col("length").alias("bytes"))
    named = with_file_info(listing.withColumn("_name", F.element_at(F.split("path", "/"), -1)), "_name", "")
    return named.where(F.col("file_dataset") == dataset).select(
        F.lit(dataset).alias("dataset"), F.col("file_symbol").alias("symbol"), range_start("file_range").alias("start"),
        range_end("file_range").alias("end"), "bytes", "path",
    )


def _plain_path(path: str | Column) -> Column:
    """One spelling of a path: Spark names local files with one slash or three."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^file:/+", "file:/")


def compact(spark: SparkSession, manifest: DataFrame, freq: str, target_bytes: int, target: str) -> DataFrame:
    """Merge small neighbouring files into the table `target`, all batches in one job: `(dataset, symbol, batch, files, rows, ok)`.

    A batch counts once its mark is there, which needs as many rows written as its files have. Until then, and for a batch
    whose numbers differ, the files themselves are read (`read_compacted`), so a run that dies changes nothing. Files of marked batches
    (`merged_files`) are read no more and may be deleted at any time.
    """
    done = merged_files(spark, target)
    plan = staged(merge_batches(manifest.join(done.select("path"), "path", "left_anti"), freq, target_bytes))
    paths = [r.path for r in plan.select("path").toLocalIterator()]  # file names only
    if not paths:
        return spark.createDataFrame([], "dataset string, symbol string, batch int, files long, rows long, ok boolean")
    run = f"r{utc_now():%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
    batches = [F.col(c).alias(f"file_{c}") for c in ("dataset", "symbol", "batch")]
    files = plan.select(*batches, _plain_path("path").alias("_path"))
    source = spark.read.parquet(*paths).withColumn("_path", _plain_path(F.col("_metadata.file_path")))
    rows = source.join(files, "_path")
    keys = ["file_dataset", "file_symbol", "file_batch"]
    out = rows.drop("_path").withColumn("run", F.lit(run))
    # a batch is one file, of about the target size
    out.repartition(*keys).sortWithinPartitions(*keys, "date").write.mode("append").option("compression", "zstd").partitionBy(
        "run", *keys).parquet(target)
    written = spark.read.schema(out.schema).parquet(target).where(F.col("run") == run).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    expected = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = plan.groupBy(*batches).agg(F.count(F.lit(1)).alias("files"), F.collect_list("path").alias("paths"))
    report = staged(sizes.join(written, keys, "left").join(expected, keys, "left").withColumn(
        "ok", F.coalesce(F.coalesce("rows", F.lit(0)) == F.coalesce("_rows", F.lit(0)), F.lit(False))))
    report.where("ok").select(*keys, "paths", F.lit(run).alias("run")).write.mode("append").parquet(_merges_of(target))
    return report.select(
        F.col("file_dataset").alias("dataset"), F.col("file_symbol").alias("symbol"), F.col("file_batch").alias("batch"), "files",
        F.coalesce("rows", F.lit(0)).alias("rows"), "ok")


_MERGES = "file_dataset string, file_symbol string, file_batch int, paths array<string>, run string"


def _merges_of(target: str) -> str:
    return f"{target.rstrip('/')}.merges"


def _merges(spark: SparkSession, target: str) -> DataFrame:
    if not exists(spark, _merges_of(target)):
        return spark.createDataFrame([], _MERGES)
    return spark.read.schema(_MERGES).parquet(_merges_of(target))


def merged_files(spark: SparkSession, target: str) -> DataFrame:
    """`(path, file_symbol, file_batch, run)` of the files whose rows are in the merged table."""
    return _merges(spark, target).select(F.explode("paths").alias("path"), "file_symbol", "file_batch", "run")


def read_compacted(spark: SparkSession, manifest: DataFrame, target: str, schema: T.StructType) -> DataFrame:
    """Rows of all files of a manifest with file_symbol and file_batch: from the merged table if they are there (its batch), else from the files."""
    merges = _merges(spark, target)
    left = manifest.join(merged_files(spark, target).select("path"), "path", "left_anti").select("symbol", "path")
    names = [*schema.names, "file_symbol", "file_batch"]
    added = [T.StructField("file_symbol", T.StringType()), T.StructField("file_batch", T.IntegerType())]
    out = spark.createDataFrame([], T.StructType([*schema.fields, *added]))
    if not merges.isEmpty():
        kept = [T.StructField(c, T.StringType()) for c in ("run", "file_dataset")]
        rows = spark.read.schema(T.StructType([*schema.fields, *added, *kept])).parquet(target)
        out = out.unionByName(rows.join(merges.select("run", "file_symbol", "file_batch"), ["run", "file_symbol", "file_batch"], "left_semi").select(*names))
    paths = [r.path for r in left.select("path").toLocalIterator()]  # file names only
    if paths:
        rows = spark.read.schema(schema).parquet(*paths).withColumn("_path", _plain_path(F.col("_metadata.file_path")))
        own = left.select(F.col("symbol").alias("file_symbol"), F.lit(None).cast("int").alias("file_batch"), _plain_path("path").alias("_path"))
        out = out.unionByName(rows.join(own, "_path").select(*names))
    return out
