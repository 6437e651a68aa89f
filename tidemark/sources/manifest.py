"""Questions about stored window files, asked of a manifest `(dataset, symbol, start, end, bytes, path)`.

A window is a calendar day or month; its file ends one minute before the next window starts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.clock import col, epoch_s, plus_seconds
from tidemark.functions.ladder import bar_of, start_of_bar
from tidemark.operators.ranges import interval_join, overlap_join
from tidemark.operators.validate import gap_runs

FREQUENCIES = {"D": "1D", "M": "1M"}


def window_end(bar: str | Column, freq: str) -> Column:
    return plus_seconds(start_of_bar(col(bar) + 1, FREQUENCIES[freq]), -60)


def whole_windows(ranges: DataFrame, freq: str, start: str = "start", end: str = "end", many: bool = False) -> DataFrame:
    """The whole windows each range touches, never cut to the range.

    With `many` long ranges the windows outnumber the calendar's by far: the ranges are dealt evenly over the tasks, since long ones
    may lie side by side, and the times of a window are looked up in the calendar of all ranges, not reckoned again for each of them.
    `ranges` is then read twice.
    """
    tf = FREQUENCIES[freq]
    first, last = bar_of(start, tf), bar_of(end, tf)
    if many:
        bounds = ranges.select(first.alias("first"), last.alias("last")).dropna().agg(
            F.min(F.least("first", "last")).alias("first"), F.max(F.greatest("first", "last")).alias("last"))
        calendar = _with_times(bounds.select(F.explode(F.sequence("first", "last")).alias("window")), freq)
        tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = ranges.repartition(tasks).withColumn("window", F.explode(F.sequence(first, last)))
        return out.join(F.broadcast(calendar), "window").select(*out.columns, "window_start", "window_end")
    return _with_times(ranges.withColumn("window", F.explode(F.sequence(first, last))), freq)


def _with_times(windows: DataFrame, freq: str) -> DataFrame:
    return windows.withColumns({
        "window_start": start_of_bar("window", FREQUENCIES[freq]), "window_end": window_end("window", freq)})


def _own_windows(manifest: DataFrame, freq: str) -> DataFrame:
    """Files that are exactly one window."""
    bar = bar_of("start", FREQUENCIES[freq])
    exact = (F.col("start") == start_of_bar(bar, FREQUENCIES[freq])) & (F.col("end") == window_end(bar, freq))
    return manifest.where(exact).withColumn("window", bar)


def covering_file(windows: DataFrame, manifest: DataFrame, longest_s: int) -> DataFrame:
    """The shortest file that holds each window whole, NULL where none does."""
    files = manifest.select("symbol", "start", "end", "path")
    key = [c for c in windows.columns]
    met = interval_join(
        windows, files.withColumn("length", epoch_s("end") - epoch_s("start")).withColumn("file_end", F.col("end")),
        ["symbol"], "window_start", "start", "end", longest_s, ["path", "length", "file_end"],
    ).where(F.col("file_end") >= F.col("window_end"))
    best = met.groupBy(*key).agg(F.min_by("path", F.struct("length", "path")).alias("path"))
    return windows.join(best, key, "left")


def covering_paths(windows: DataFrame, manifest: DataFrame, longest_s: int) -> DataFrame:
    """The distinct files one scan has to read for a set of windows."""
    return covering_file(windows, manifest, longest_s).where("path is not null").select("path").distinct()


def missing_windows(requested: DataFrame, manifest: DataFrame, freq: str, now: Column, longest_s: int = 40 * 86_400) -> DataFrame:
    """Closed windows of the requested ranges that neither have their own file nor lie inside a longer one."""
    windows = whole_windows(requested, freq).select("symbol", "window", "window_start", "window_end").distinct()
    open_or_later = F.col("window_end") >= now
    return covering_file(windows.where(~open_or_later), manifest, longest_s).where("path is null").drop("path")


def cache_gaps(requested: DataFrame, manifest: DataFrame, freq: str, now: Column) -> DataFrame:
    """Missing windows, neighbours merged: `(symbol, start, end, windows)`."""
    tf = FREQUENCIES[freq]
    missing = missing_windows(requested, manifest, freq, now).select(
        "symbol", F.col("window").alias("bar"), F.col("window_start").alias("date")
    )
    runs = gap_runs(missing, tf)
    return runs.select(
        "symbol", "start", window_end(bar_of("end", tf), freq).alias("end"), F.col("bars").alias("windows")
    )


def overlapping_files(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file that overlaps a requested range at all, by its start."""
    return overlap_join(requested, manifest, ["symbol"], 30 * 86_400, ["path", "start", "end"]).orderBy(
        "symbol", "other_start", "other_path"
    )


def redundant_files(manifest: DataFrame, freq: str) -> DataFrame:
    """Files of several windows each of which also exists as its own file. Nothing is deleted here."""
    own = _own_windows(manifest, freq).select("symbol", "window").distinct().withColumn("_own", F.lit(True))
    files = manifest.select("symbol", "path", "start", "end")
    spans = whole_windows(files, freq).groupBy("symbol", "path").agg(F.count(F.lit(1)).alias("_n"))
    checked = (
        whole_windows(files, freq)
        .join(own, ["symbol", "window"], "left")
        .groupBy("symbol", "path")
        .agg(F.bool_and(F.coalesce("_own", F.lit(False))).alias("redundant"))
    )
    return checked.join(spans, ["symbol", "path"]).where("redundant and _n > 1").select("symbol", "path", F.col("_n").alias("windows"))


def backfill_plan(gaps: DataFrame, known_empty: DataFrame) -> DataFrame:
    """Gaps to fetch, the newest first, without those that were found empty before."""
    return gaps.join(known_empty.select("symbol", "start", "end"), ["symbol", "start", "end"], "left_anti").orderBy(
        F.desc("start"), "symbol"
    )


def cache_summary(manifest: DataFrame) -> DataFrame:
    """Per symbol the number of files, the whole span, and the longest single file in seconds."""
    return manifest.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("files"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max(epoch_s("end") - epoch_s("start")).alias("longest_s"),
    )


def write_rate_alerts(writes: DataFrame, threshold: int, time: str = "written_at") -> DataFrame:
    """Days and datasets with more bytes written than the threshold."""
    return (
        writes.groupBy("dataset", start_of_bar(bar_of(time, "1D"), "1D").alias("day"))
        .agg(F.sum("bytes").alias("bytes"))
        .where(F.col("bytes") > threshold)
    )


def window_coverage(
    rows: DataFrame, windows: DataFrame, expected: Sequence[str], freq: str, not_null: Sequence[str] = ()
) -> DataFrame:
    """State of each window by the timeframes its stored rows have: covered, missing, or partial.

    Rows in which a column of `not_null` is NULL do not count.
    """
    valid = rows.dropna(subset=list(not_null)) if not_null else rows
    found = valid.groupBy("symbol", bar_of("date", FREQUENCIES[freq]).alias("window")).agg(
        F.collect_set("timeframe").alias("_found")
    )
    want = F.array(*[F.lit(t) for t in expected])
    out = windows.join(found, ["symbol", "window"], "left").withColumn(
        "lacking", F.array_sort(F.array_except(want, F.coalesce("_found", F.array().cast("array<string>"))))
    )
    state = (
        F.when(F.size("lacking") == 0, "covered").when(F.size("lacking") == len(expected), "missing").otherwise("partial")
    )
    return out.withColumn("state", state).drop("_found")


class PartialCoverageError(ValueError):
    """Windows have rows of some timeframes only; nothing is patched silently. `windows` has all of them."""

    def __init__(self, n: int, windows: DataFrame):
        super().__init__(f"{n} windows have rows of some timeframes only")
        self.windows = windows


def require_whole_windows(coverage: DataFrame) -> DataFrame:
    bad = coverage.where("state = 'partial'").select("symbol", "window", "lacking")
    n = bad.count()
    if n:
        raise PartialCoverageError(n, bad)
    return coverage


def merge_batches(manifest: DataFrame, freq: str, target_bytes: int) -> DataFrame:
    """Which single-window files to merge: neighbours in time order until a batch reaches the target size.

    A batch of one file is no merge. The walk is over file sizes, one number per window of a series.
    """
    def walk(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("window").reset_index(drop=True)
        batch, size, previous, numbers = 0, 0, None, []
        for window, weight in zip(files["window"], files["bytes"], strict=True):
            if previous is not None and (size >= target_bytes or window != previous + 1):
                batch, size = batch + 1, 0
            numbers.append(batch)
            size, previous = size + weight, window
        files["batch"] = numbers
        return files

    own = _own_windows(manifest, freq).select("dataset", "symbol", "window", "start", "end", "bytes", "path")
    schema = T.StructType([*own.schema.fields, T.StructField("batch", T.IntegerType())])
    numbered = own.groupBy("dataset", "symbol").applyInPandas(walk, schema)
    sizes = numbered.groupBy("dataset", "symbol", "batch").agg(F.count(F.lit(1)).alias("files"))
    return numbered.join(sizes.where("files > 1"), ["dataset", "symbol", "batch"])
