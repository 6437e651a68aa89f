from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import bar_of
from tidemark.functions.scalars import normalized_timeframe
from tidemark.operators import validate as vd
from tidemark.queries.storage_queries import calendar_windows
from tidemark.sources import manifest as mf
from tidemark.sources import sinks
from tidemark.sources.readers import raw_to_candles, read_any, read_range

SIMPLE = T.StructType([T.StructField("date", T.TimestampNTZType(), False), T.StructField("value", T.DoubleType(), False)])


def day(n, minutes=0):
    return datetime(2024, 8, n) + timedelta(minutes=minutes)


def manifest(spark, files):
    rows = [("ohlcv", "s", a, b, size, f"{a:%d}-{b:%d}") for a, b, size in files]
    return spark.createDataFrame(rows, "dataset string, symbol string, start timestamp_ntz, end timestamp_ntz, bytes long, path string")


def one(n, size=10):
    return day(n), day(n, 1439), size


def test_gaps_are_merged_and_open_windows_left_out(spark):
    files = manifest(spark, [one(n) for n in (1, 5, 6, 7, 9)])
    asked = spark.createDataFrame([("s", day(1), day(10, 600))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    now = F.lit(day(10, 700)).cast("timestamp_ntz")
    gaps = mf.cache_gaps(asked, files, "D", now).orderBy("start").collect()
    assert [(g.start, g.end, g.windows) for g in gaps] == [(day(2), day(4, 1439), 3), (day(8), day(8, 1439), 1)]
    # a longer file covers the windows inside it
    wide = manifest(spark, [(day(1), day(4, 1439), 40), *[one(n) for n in (5, 6, 7, 9)]])
    assert [g.start for g in mf.cache_gaps(asked, wide, "D", now).collect()] == [day(8)]


def test_merge_batches(spark):
    files = manifest(spark, [one(1, 40), one(2, 40), one(3, 40), one(9, 10)])
    rows = mf.merge_batches(files, "D", 50).collect()
    assert sorted(r.path for r in rows) == ["01-01", "02-02"]


def test_redundant_and_covering(spark):
    files = manifest(spark, [one(1), one(2), (day(1), day(2, 1439), 20), (day(2), day(3, 1439), 20)])
    assert [r.path for r in mf.redundant_files(files, "D").collect()] == ["01-02"]
    windows = spark.createDataFrame([("s", day(n), day(n, 1439)) for n in (1, 3, 4)], "symbol string, window_start timestamp_ntz, window_end timestamp_ntz")
    found = {r.window_start.day: r.path for r in mf.covering_file(windows, files, 86_400).collect()}
    assert found == {1: "01-01", 3: "02-03", 4: None}


def test_windows_of_many_ranges_are_looked_up(spark):
    ends = [(0, 0), (0, 40), (30, 61), (200, 1300), (1300, 200), (59, 59), (5, None), (None, 5)] * 2
    rows = [(i, *[None if n is None else datetime(2023, 12, 31, 23, 59) + timedelta(days=n) for n in pair]) for i, pair in enumerate(ends)]
    ranges = spark.createDataFrame([*rows, (None, day(1), day(9))], "id long, start timestamp_ntz, end timestamp_ntz")
    for freq in ("D", "M"):
        plain, many = mf.whole_windows(ranges, freq), mf.whole_windows(ranges, freq, many=True)
        assert many.columns == plain.columns and many.count() == plain.count() > 100
        assert many.exceptAll(plain).isEmpty() and plain.exceptAll(many).isEmpty()
    nothing = mf.whole_windows(ranges.where("id < 0"), "M", many=True)
    assert nothing.isEmpty()


def test_calendar_windows_are_shared_out_and_reckoned_once(spark, tmp_path):
    # one file and one task to read it; the long ranges come last, side by side
    orders = spark.range(4000).select(
        F.col("id").alias("o_orderkey"), F.expr("if(id < 3000, 0, id * 24)").alias("o_custkey"),
        F.lit("2024-01-31 10:00:00").cast("timestamp_ntz").alias("o_orderdate"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    out = calendar_windows(spark, str(tmp_path))
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and max(tasks) < 1.5 * sum(tasks) / 4
    # dates are made in the calendar, not for each window of each order
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "make_date" not in plan[0] and any("make_date" in line for line in plan)


def test_partial_coverage_is_an_error(spark):
    rows = spark.createDataFrame([("s", "1h", day(1)), ("s", "4h", day(1)), ("s", "1h", day(2))], "symbol string, timeframe string, date timestamp_ntz")
    windows = rows.select("symbol", bar_of("date", "1D").alias("window")).distinct()
    state = mf.window_coverage(rows, windows, ["1h", "4h"], "D")
    assert sorted(r.state for r in state.collect()) == ["covered", "partial"]
    with pytest.raises(mf.PartialCoverageError, match="1 windows") as error:
        mf.require_whole_windows(state)
    assert [r.lacking for r in error.value.windows.collect()] == [["4h"]]


def test_missing_windows_are_generated_once(spark, tmp_path):
    calls = []

    def generate(session, missing):
        calls.append(sorted((r.start, r.end) for r in missing.collect()))
        return missing.select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), "start").select(
            plus_seconds("start", F.col("h") * 3600).alias("date"), F.col("h").cast("double").alias("value"))

    table = str(tmp_path / "t")
    args = (spark, table, "x", day(1), day(3, 600), generate, SIMPLE)
    first = sinks.read_or_generate(*args, now=day(20)).orderBy("date").collect()
    second = sinks.read_or_generate(*args, now=day(20)).orderBy("date").collect()
    assert first == second and len(first) == 59
    assert calls == [[(day(n), day(n + 1)) for n in (1, 2, 3)]]
    # only the new days are asked for, and the open one is never stored
    sinks.read_or_generate(spark, table, "x", day(1), day(5, 60), generate, SIMPLE, now=day(5, 60))
    assert calls[1:] == [[(day(4), day(5))], [(day(5), day(6))]]
    stored = {r.window for r in spark.read.parquet(table).select("window").distinct().collect()}
    assert len(stored) == 4
    # a hook may change what was read
    hooked = sinks.read_or_generate(*args, now=day(20), after_read=lambda df: df.where("value < 5"))
    assert hooked.count() == 15 and len(calls) == 3
    # a dataset that looks ahead waits longer
    sinks.register_maturity("slow", timedelta(days=2))
    slow = str(tmp_path / "slow")
    sinks.read_or_generate(spark, slow, "slow", day(1), day(4, 60), generate, SIMPLE, now=day(5))
    assert spark.read.parquet(slow).select("window").distinct().count() == 2


KEYED = T.StructType([T.StructField("symbol", T.StringType(), False), T.StructField("timeframe", T.StringType(), False), *SIMPLE.fields])


def test_windows_are_known_by_symbol_and_empty_ones_too(spark, tmp_path):
    calls = []

    def generate(session, missing):
        """A row a day, none on the third; and rows nobody asked for, which are left out."""
        calls.append(sorted((r.symbol, r.start.day) for r in missing.collect()))
        rows = missing.where(F.dayofmonth("start") != 3).select("symbol", F.lit("1h").alias("timeframe"), F.col("start").alias("date"), F.lit(1.0).alias("value"))
        return rows.unionByName(rows.withColumn("symbol", F.lit("other")))

    def read(symbols, last=4):
        series = spark.createDataFrame([(s,) for s in symbols], "symbol string")
        out = sinks.read_or_generate(spark, table, "x", day(1), day(last, 60), generate, KEYED, now=day(20), series=series)
        return sorted((r.symbol, r.date.day) for r in out.collect())

    table = str(tmp_path / "t")
    assert read("a") == [("a", 1), ("a", 2), ("a", 4)] and calls == [[("a", n) for n in (1, 2, 3, 4)]]
    both = [(s, d) for s in "ab" for d in (1, 2, 4)]
    assert read("ab") == both and calls[1:] == [[("b", n) for n in (1, 2, 3, 4)]]  # b came later, and only b is asked for
    assert read("ab") == both and read("b") == both[3:] and len(calls) == 2  # the empty day is known
    assert len(read("ab", 5)) == 8 and calls[2:] == [[("a", 5), ("b", 5)]]
    assert read("") == []
    with pytest.raises(ValueError, match="series"):
        sinks.read_or_generate(spark, table, "x", day(1), day(2), generate, KEYED, now=day(20))


def test_failed_and_partial_windows(spark, tmp_path):
    series = spark.createDataFrame([("a",)], "symbol string")

    def store(table, rows, schema=KEYED, last=2, **options):
        def generate(session, missing):
            return session.createDataFrame(rows, "symbol string, timeframe string, date timestamp_ntz, value double")

        return sinks.read_or_generate(spark, table, "x", day(1), day(last), generate, schema, now=day(20), series=series, **options)

    table = str(tmp_path / "t")
    with pytest.raises(vd.SchemaError, match="value"):
        store(table, [("a", "1h", day(1), None)])
    # its windows are still missing, and the rows that were refused are not seen
    assert [r.value for r in store(table, [("a", "1h", day(1), 2.0)]).collect()] == [2.0]
    nullable = T.StructType([*KEYED.fields[:3], T.StructField("value", T.DoubleType())])
    with pytest.raises(mf.PartialCoverageError, match="1 windows"):
        store(table, [("a", "1h", day(3), 1.0)], nullable, 3, timeframes=["1h", "4h"])
    # windows with NULL only are made again
    table = str(tmp_path / "n")
    store(table, [("a", "1h", day(1), None)], nullable)
    again = store(table, [("a", "1h", day(1), 5.0)], nullable, timeframes=["1h"], not_null=["value"])
    assert [r.value for r in again.collect()] == [5.0]


def test_single_result_is_read_or_generated(spark, tmp_path):
    def generate(session, start, end):
        return session.createDataFrame([(start, 1.0)], SIMPLE)

    path = str(tmp_path / "one")
    a = sinks.read_or_generate_one(spark, path, day(1), day(2), generate, SIMPLE, now=day(9)).collect()
    assert sinks.exists(spark, path)
    b = sinks.read_or_generate_one(spark, path, day(1), day(2), None, SIMPLE, now=day(9)).collect()
    assert a == b
    with pytest.raises(ValueError, match="empty"):
        sinks.read_or_generate_one(spark, path + "2", day(1), day(2), lambda s, x, y: vd.empty(s, SIMPLE), SIMPLE)


def test_null_guard_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(day(1), float("nan"), "a"), (day(2), 1.0, "a")], "date timestamp_ntz, value double, part string")
    path = str(tmp_path / "t")
    with pytest.raises(vd.SchemaError, match="value"):
        sinks.write_checked(rows, path, SIMPLE, ["part"])
    assert not sinks.exists(spark, path)
    nullable = T.StructType([SIMPLE["date"], T.StructField("value", T.DoubleType())])
    assert sinks.write_checked(rows, path, nullable, ["part"]).where("value is null").count() == 1


def test_conform_and_decorator(spark):
    raw = spark.createDataFrame([("2024-08-01", "1.5", 7)], "date string, value string, more int")
    assert vd.conform(raw, SIMPLE).columns == ["date", "value"]
    assert vd.conform(raw, SIMPLE, strict=False).columns == ["date", "value", "more"]
    with pytest.raises(vd.SchemaError, match="missing"):
        vd.conform(raw.drop("value"), SIMPLE)
    with pytest.raises(vd.SchemaError):
        vd.reject_timeframe(raw.withColumn("timeframe", F.lit("1h")))
    with pytest.raises(vd.SchemaError, match="duplicate"):
        vd.require_unique(raw.union(raw), ["date"])

    @vd.with_schemas(result=SIMPLE, df=SIMPLE)
    def double(df):
        return df.withColumn("value", F.col("value") * 2)

    assert double(raw).collect()[0].value == 3.0


def small_files(root, days):
    for n in days:
        frame = pd.DataFrame({"date": [day(n), day(n, 60)], "value": [1.0 * n, 2.0 * n]})
        frame["date"] = frame["date"].astype("datetime64[us]")
        frame.to_parquet(root / f"s.ohlcv.24-08-0{n}.00-00T24-08-0{n}.23-59.parquet")


def test_compaction_by_marks(spark, tmp_path):
    root, target = tmp_path / "files", str(tmp_path / "merged")
    root.mkdir()
    small_files(root, (1, 2, 3, 7))
    files = sinks.manifest_of(spark, str(root), "ohlcv")
    assert files.count() == 4

    def values():
        return sorted((r.value, r.file_batch) if r.file_batch is not None else (r.value, -1) for r in
                      sinks.read_compacted(spark, sinks.manifest_of(spark, str(root), "ohlcv"), target, SIMPLE).collect())

    before = values()
    assert [b for _, b in before] == [-1] * 8
    report = sinks.compact(spark, files, "D", 10**9, target).collect()
    assert [(r.symbol, r.files, r.rows, r.ok) for r in report] == [("s", 3, 6, True)]
    assert sorted(r.path.rsplit("/", 1)[1][:16] for r in sinks.merged_files(spark, target).collect()) == [f"s.ohlcv.24-08-0{n}" for n in (1, 2, 3)]
    assert [v for v, _ in values()] == [v for v, _ in before] and sum(b >= 0 for _, b in values()) == 6
    assert len(list((tmp_path / "merged").rglob("part-*"))) == 1
    assert sinks.compact(spark, files, "D", 10**9, target).count() == 0  # nothing is merged twice
    # files of marked batches are not needed, new neighbours are merged on their own
    for path in root.glob("s.ohlcv.24-08-0[123]*"):
        path.unlink()
    small_files(root, (8,))
    assert sinks.compact(spark, sinks.manifest_of(spark, str(root), "ohlcv"), "D", 10**9, target).first().files == 2
    assert sorted(v for v, _ in values()) == sorted([*[v for v, _ in before], 8.0, 16.0])


def test_a_compaction_that_died_changes_nothing(spark, tmp_path):
    root, target = tmp_path / "files", tmp_path / "merged"
    root.mkdir()
    small_files(root, (1, 2))
    files = sinks.manifest_of(spark, str(root), "ohlcv")
    rows = spark.createDataFrame([(day(1), 99.0)], SIMPLE).withColumns({
        "run": F.lit("dead"), "file_dataset": F.lit("ohlcv"), "file_symbol": F.lit("s"), "file_batch": F.lit(0)})
    rows.write.partitionBy("run", "file_dataset", "file_symbol", "file_batch").parquet(str(target))  # rows without a mark
    read = lambda: sorted(r.value for r in sinks.read_compacted(spark, files, str(target), SIMPLE).collect())
    assert read() == [1.0, 2.0, 2.0, 4.0]
    assert sinks.compact(spark, files, "D", 10**9, str(target)).first().ok
    assert read() == [1.0, 2.0, 2.0, 4.0]


def test_stored_windows_are_rewritten_by_version(spark, tmp_path):
    table, series = str(tmp_path / "t"), spark.createDataFrame([("a",), ("b",)], "symbol string")

    def generate(session, missing):
        name = F.when(F.col("symbol") == "a", "1H").otherwise("4h")
        return missing.select("symbol", name.alias("timeframe"), F.col("start").alias("date"), F.lit(1.0).alias("value"))

    def read():
        out = sinks.read_or_generate(spark, table, "x", day(1), day(2, 60), generate, KEYED, now=day(20), series=series)
        return sorted((r.symbol, r.timeframe, r.date.day) for r in out.collect())

    assert read() == [("a", "1H", 1), ("a", "1H", 2), ("b", "4h", 1), ("b", "4h", 2)]
    assert sinks.rewritten(spark, table, KEYED, "timeframe", normalized_timeframe("timeframe")) == 2  # b stays as it is
    assert read() == [("a", "1h", 1), ("a", "1h", 2), ("b", "4h", 1), ("b", "4h", 2)]
    assert sinks.rewritten(spark, table, KEYED, "timeframe", normalized_timeframe("timeframe")) == 0


def test_readers(spark, tmp_path):
    frame = pd.DataFrame({"date": [str(day(1)), str(day(2))], "value": [1.0, 2.0]})
    frame.to_csv(tmp_path / "good.csv", index=False)
    assert sorted(r.value for r in read_any(spark, str(tmp_path / "good"), SIMPLE).collect()) == [1.0, 2.0]
    spark.createDataFrame([(day(3), 3.0)], SIMPLE).write.parquet(str(tmp_path / "good.parquet"))
    assert read_any(spark, str(tmp_path / "good"), SIMPLE).first().value == 3.0
    with pytest.raises(FileNotFoundError):
        read_any(spark, str(tmp_path / "none"), SIMPLE)


def test_raw_rows(spark):
    raw = spark.createDataFrame([("s", 1722470400000, "1", "3", "0.5", "2", "10")], "symbol string, ms long, open string, high string, low string, close string, volume string")
    row = raw_to_candles(raw, "1min").first()
    assert (row.date, row.open, row.high, row.volume, row.timeframe) == (day(1), 1.0, 3.0, 10.0, "1min")


def test_range_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(day(n), float(n)) for n in range(1, 9)], SIMPLE).write.parquet(path)
    rows = read_range(spark, [path], "2024-08-02", "2024-08-04").select("value")
    assert sorted(r.value for r in rows.collect()) == [2.0, 3.0, 4.0]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan


def test_sample_batches(spark, tmp_path):
    path = str(tmp_path / "b")
    sinks.write_batches(spark.range(10).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x")).coalesce(1), path, 4)
    assert len(list((tmp_path / "b").glob("part-*"))) == 3
    assert spark.read.parquet(path).count() == 10
