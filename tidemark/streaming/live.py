"""The live edge: closed candles from a stream of ticks, labels once their horizon is over, windowed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import TF_MINUTES, bar_of, floor_to_bar
from tidemark.operators.resample import order_key
from tidemark.session import staged

WEEK_START = "4 days"


def _width(tf: str) -> str:
    return f"{TF_MINUTES[tf]} minutes"


def unique_ticks(ticks: DataFrame, late: str, keys: tuple[str, ...] = ("symbol", "seq")) -> DataFrame:
    """Drop repeated ticks and those later than the watermark; state is kept only as long as that."""
    return ticks.withWatermark("date", late).dropDuplicatesWithinWatermark(list(keys))


def closed_candles(ticks: DataFrame, tf: str, late: str) -> DataFrame:
    """Candles of a stream `(symbol, date, seq, price, volume)`, each once, when no tick of it can come any more.

    Append mode gives a candle out when the watermark passes its end, so an open candle is never seen.
    """
    key = order_key(ticks, ("date", "seq"))
    start = WEEK_START if tf == "1W" else "0 seconds"
    return (
        ticks.withWatermark("date", late)
        .groupBy("symbol", F.window("date", _width(tf), startTime=start).alias("_w"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def into_table(stream: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
               tf: str = "1D") -> DataStreamWriter:
    """Append a stream to a table of windows, each micro-batch as a run of its own; nothing stored is rewritten.

    A batch overwrites its own run and its own marks only, so one that runs twice after a failure changes nothing, and rows count once the
    marks are there. `live_rows` reads the table, `compact_windows` merges windows that many batches have touched.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows = staged(rows.withColumns({"window": bar_of("date", tf), "run": F.lit(f"b{number:012d}")}))
        _put(rows, table, f"{table.rstrip('/')}.runs")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _put(rows: DataFrame, table: str, marks: str) -> None:
    by_run = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    rows.write.mode("overwrite").options(**by_run).partitionBy("run", "window").parquet(table)
    rows.select("run", "window").distinct().write.mode("overwrite").options(**by_run).partitionBy("run").parquet(marks)


def _live_runs(spark: SparkSession, table: str) -> DataFrame:
    """`(window, run, runs)`: the runs of each window from its last merged one on (its name ends in `+`), and how many there are."""
    marks = spark.read.schema("window long, run string").parquet(f"{table.rstrip('/')}.runs")
    w = Window.partitionBy("window")
    merged = F.max(F.when(F.col("run").endswith("+"), F.col("run"))).over(w)
    live = marks.withColumn("_merged", merged).where(F.col("_merged").isNull() | (F.col("run") >= F.col("_merged"))).drop("_merged")
    return live.withColumn("runs", F.count(F.lit(1)).over(w))


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows with one key those of the latest run. Only windows of several runs are sorted, key by key."""
    latest = Window.partitionBy("window", *keys).orderBy(F.desc("run"))
    several = rows.where("runs > 1").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return rows.where("runs = 1").unionByName(several)


def live_rows(spark: SparkSession, table: str, schema: T.StructType, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """What a streamed table holds: of each key the row that came last."""
    stored = T.StructType([*schema.fields, T.StructField("window", T.LongType()), T.StructField("run", T.StringType())])
    rows = spark.read.schema(stored).parquet(table).join(_live_runs(spark, table), ["window", "run"])
    return _newest(rows, keys).select(*schema.names)


def compact_windows(
    spark: SparkSession, table: str, schema: T.StructType, keys: Sequence[str] = ("symbol", "date"), most_runs: int = 1
) -> int:
    """Merge the runs of every window that has more than `most_runs` into one, in one job; how many windows there were.

    The merged run is named after the last one it holds, so later batches still come after it, and takes their place when its mark is
    there. Merging what is merged, or again after a failure, gives the same rows.
    """
    stored = T.StructType([*schema.fields, T.StructField("window", T.LongType()), T.StructField("run", T.StringType())])
    crowded = staged(_live_runs(spark, table).where(F.col("runs") > most_runs))
    last = crowded.groupBy("window").agg(F.concat(F.regexp_replace(F.max("run"), r"\+$", ""), F.lit("+")).alias("_run"))
    n = last.count()
    if n:
        rows = spark.read.schema(stored).parquet(table).join(crowded, ["window", "run"])
        merged = staged(_newest(rows, keys).join(last, "window").drop("run", "runs").withColumnRenamed("_run", "run"))
        _put(merged, table, f"{table.rstrip('/')}.runs")
    return n


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Take in all there is now and stop, for back-fills and tests."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def mature_by(rows: DataFrame, tf: str, wait_bars: int, now) -> DataFrame:
    """Batch form of the maturity rule: rows whose bar, and `wait_bars` after it, are closed at `now`."""
    return rows.where(plus_seconds("date", TF_MINUTES[tf] * 60 * (1 + wait_bars)) <= now)


def latest_closed(candles: DataFrame, tf: str, now, n: int) -> DataFrame:
    """The last `n` closed bars of each series at `now`: what a sample taken then may see."""
    last = bar_of(floor_to_bar(now, tf), tf) - 1
    return candles.where((F.col("bar") <= last) & (F.col("bar") > last - n))
