"""Windowed storage: manifests, gaps, coverage, plans, and tables that fill their own gaps."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.clock import epoch_us, plus_seconds
from tidemark.functions.ladder import bar_of
from tidemark.functions.scalars import normalized_timeframe
from tidemark.operators import validate as vd
from tidemark.operators.blocks import framed
from tidemark.operators.smoothing import add_atr
from tidemark.plans import sampling as sp
from tidemark.plans.profit import add_long_short_profit
from tidemark.queries import query
from tidemark.queries.feature_queries import D, H, Q, RISK, SQL_DRAWDOWN, SQL_EXTREMES, SQL_PROFIT
from tidemark.queries.structure_queries import sql_mt_atr
from tidemark.queries.views import candles, daily_raw, ntz, raw_candles, s6, sql_atr, sql_candles, sql_daily, sql_ewm, sql_stacked, stacked, table, ticks
from tidemark.session import shared_folder, staged
from tidemark.sources import manifest as mf
from tidemark.sources import sinks
from tidemark.sources.readers import raw_to_candles

KEY = ["symbol", "date"]
NOW = "2024-01-28 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _manifest(spark, sf):
    """A manifest the ticks give: days with at least 60 ticks count as stored, weeks with at least 470 too."""
    days = ticks(spark, sf).groupBy("symbol", F.date_trunc("day", "date").cast("timestamp_ntz").alias("start")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n >= 60").withColumn("end", plus_seconds("start", 86_400 - 60))
    weeks = ticks(spark, sf).groupBy("symbol", F.date_trunc("week", "date").cast("timestamp_ntz").alias("start")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n >= 470").withColumn("end", plus_seconds("start", 7 * 86_400 - 60))
    name = F.concat(F.col("symbol"), F.lit("/"), F.date_format("start", "yy-MM-dd"), F.lit("T"), F.date_format("end", "yy-MM-dd"))
    return staged(
        days.unionByName(weeks).select(
            F.lit("ohlcv").alias("dataset"), "symbol", "start", "end", (F.col("n") * 100).alias("bytes"), name.alias("path")
        )
    )


SQL_MANIFEST = """
d AS (SELECT event_type AS symbol, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 60),
wk AS (SELECT event_type AS symbol, date_trunc('week', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 470),
m0 AS (SELECT symbol, start, start + INTERVAL 1 DAY - INTERVAL 1 MINUTE AS "end", n FROM d UNION ALL SELECT symbol, start, start + INTERVAL 7 DAY - INTERVAL 1 MINUTE, n FROM wk),
m AS (SELECT *, n * 100 AS bytes, symbol || '/' || strftime(start, '%y-%m-%d') || 'T' || strftime("end", '%y-%m-%d') AS path FROM m0),
rq AS (SELECT event_type AS symbol, min(ts) AS start, max(ts) AS "end" FROM events GROUP BY 1),
win AS (SELECT symbol, unnest(generate_series(date_trunc('day', start), date_trunc('day', "end"), INTERVAL 1 DAY)) AS ws FROM rq),
cov AS (SELECT w.symbol, w.ws, (SELECT arg_min(f.path, epoch(f."end" - f.start) * 1e6 + CASE WHEN f.path < '' THEN 1 ELSE 0 END) FROM m f
  WHERE f.symbol = w.symbol AND f.start <= w.ws AND f."end" >= w.ws + INTERVAL 1 DAY - INTERVAL 1 MINUTE) AS path FROM win w),
miss AS (SELECT symbol, ws FROM cov WHERE path IS NULL AND ws + INTERVAL 1 DAY - INTERVAL 1 MINUTE < TIMESTAMP '{now}'),
isl AS (SELECT symbol, ws, ws - INTERVAL (row_number() OVER (PARTITION BY symbol ORDER BY ws)) DAY AS i FROM miss),
gaps AS (SELECT symbol, min(ws) AS start, max(ws) + INTERVAL 1 DAY - INTERVAL 1 MINUTE AS "end", count(*) AS windows FROM isl GROUP BY symbol, i)""".replace("{now}", NOW)


def _requested(spark, sf):
    return ticks(spark, sf).groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))


@query("cache_gaps", f'WITH {SQL_MANIFEST} SELECT symbol, start, "end", windows FROM gaps')
def cache_gaps(spark, sf):
    return mf.cache_gaps(_requested(spark, sf), _manifest(spark, sf), "D", _now())


@query("covering_files", f"WITH {SQL_MANIFEST} SELECT symbol, ws AS window_start, path FROM cov")
def covering_files(spark, sf):
    windows = mf.whole_windows(_requested(spark, sf), "D").select("symbol", "window", "window_start", "window_end")
    return mf.covering_file(windows, _manifest(spark, sf), 7 * 86_400).select("symbol", "window_start", "path")


@query("covering_scan_paths", f"WITH {SQL_MANIFEST} SELECT DISTINCT path FROM cov WHERE path IS NOT NULL")
def covering_scan_paths(spark, sf):
    windows = mf.whole_windows(_requested(spark, sf), "D").select("symbol", "window", "window_start", "window_end")
    return mf.covering_paths(windows, _manifest(spark, sf), 7 * 86_400)


@query("overlapping_files", f"""WITH {SQL_MANIFEST}
SELECT m.symbol, m.path FROM m WHERE m.start < TIMESTAMP '2024-01-16 07:00:00' AND m."end" > TIMESTAMP '2024-01-09 12:00:00'""")
def overlapping_files(spark, sf):
    asked = _requested(spark, sf).select(
        "symbol", F.lit("2024-01-09 12:00:00").cast("timestamp_ntz").alias("start"),
        F.lit("2024-01-16 07:00:00").cast("timestamp_ntz").alias("end"),
    )
    return mf.overlapping_files(asked, _manifest(spark, sf)).select("symbol", F.col("other_path").alias("path"))


@query("redundant_files", f"""WITH {SQL_MANIFEST},
w AS (SELECT symbol, path, unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS ws FROM m WHERE "end" - start > INTERVAL 1 DAY)
SELECT w.symbol, w.path, count(*) AS windows FROM w LEFT JOIN d ON d.symbol = w.symbol AND d.start = w.ws GROUP BY 1, 2 HAVING bool_and(d.start IS NOT NULL)""")
def redundant_files(spark, sf):
    return mf.redundant_files(_manifest(spark, sf), "D")


@query("calendar_windows", """SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL (o_custkey) HOUR), INTERVAL 1 MONTH)) AS window_start,
  unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL (o_custkey) HOUR), INTERVAL 1 MONTH)) + INTERVAL 1 MONTH - INTERVAL 1 MINUTE AS window_end FROM orders""")
def calendar_windows(spark, sf):
    ranges = table(spark, sf, "orders").select(
        "o_orderkey", ntz("o_orderdate").alias("start"), plus_seconds(ntz("o_orderdate"), F.col("o_custkey") * 3600).alias("end")
    )
    return mf.whole_windows(ranges, "M", many=True).select("o_orderkey", "window_start", "window_end")


@query("backfill_plan", f"""WITH {SQL_MANIFEST} SELECT symbol, start, "end", windows FROM gaps WHERE windows <> 1""")
def backfill_plan(spark, sf):
    gaps = staged(mf.cache_gaps(_requested(spark, sf), _manifest(spark, sf), "D", _now()))
    return mf.backfill_plan(gaps, gaps.where("windows = 1"))


@query("cache_summary", f"""WITH {SQL_MANIFEST} SELECT symbol, count(*) AS files, min(start) AS start, max("end") AS "end",
  CAST(max(epoch("end" - start)) AS BIGINT) AS longest_s FROM m GROUP BY 1""")
def cache_summary(spark, sf):
    return mf.cache_summary(_manifest(spark, sf))


@query("merge_batches", f"""WITH RECURSIVE {SQL_MANIFEST},
o AS (SELECT symbol, start, bytes, row_number() OVER (PARTITION BY symbol ORDER BY start) AS k FROM m WHERE "end" - start < INTERVAL 1 DAY),
walk AS (SELECT symbol, start, bytes, k, bytes AS size, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.symbol, o.start, o.bytes, o.k, CASE WHEN w.size >= 20000 OR o.start <> w.start + INTERVAL 1 DAY THEN o.bytes ELSE w.size + o.bytes END,
    w.batch + CASE WHEN w.size >= 20000 OR o.start <> w.start + INTERVAL 1 DAY THEN 1 ELSE 0 END FROM walk w JOIN o ON o.symbol = w.symbol AND o.k = w.k + 1)
SELECT symbol, start, batch, files FROM (SELECT *, count(*) OVER (PARTITION BY symbol, batch) AS files FROM walk) WHERE files > 1""")
def merge_batches(spark, sf):
    return mf.merge_batches(_manifest(spark, sf), "D", 20_000).select("symbol", "start", "batch", "files")


@query("write_rate_alerts", """SELECT event_type AS dataset, date_trunc('day', ts) AS day, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS bytes
FROM events GROUP BY 1, 2 HAVING sum(CAST(floor(value * 1000) AS BIGINT)) > 3600000""")
def write_rate_alerts(spark, sf):
    writes = ticks(spark, sf).select(
        F.col("symbol").alias("dataset"), F.col("date").alias("written_at"), F.floor(F.col("price") * 1000).alias("bytes")
    )
    return mf.write_rate_alerts(writes, 3_600_000)


@query("timeframe_coverage", f"""WITH {sql_mt_atr()},
w AS (SELECT symbol, unnest(generate_series(min(date_trunc('day', date)), max(date_trunc('day', date)), INTERVAL 1 DAY)) AS day FROM mta GROUP BY 1),
f AS (SELECT symbol, date_trunc('day', date) AS day, count(DISTINCT timeframe) AS n FROM mta WHERE atr IS NOT NULL AND timeframe IN ('1h', '4h', '1D') GROUP BY 1, 2)
SELECT w.symbol, w.day AS window_start, CASE coalesce(n, 0) WHEN 3 THEN 'covered' WHEN 0 THEN 'missing' ELSE 'partial' END AS state FROM w LEFT JOIN f USING (symbol, day)""")
def timeframe_coverage(spark, sf):
    rows = staged(add_atr(stacked(spark, sf), 5))
    windows = mf.whole_windows(
        rows.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end")), "D"
    ).select("symbol", "window", "window_start")
    three = rows.where(F.col("timeframe").isin("1h", "4h", "1D"))
    return mf.window_coverage(three, windows, ["1h", "4h", "1D"], "D", ["atr"]).select("symbol", "window_start", "state")


@query("stitched_files", f"""WITH {sql_candles()}
SELECT symbol, date, close, CASE WHEN date < TIMESTAMP '2024-01-20' THEN 'first' ELSE 'second' END AS source FROM raw_1h
WHERE date BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-27'""")
def stitched_files(spark, sf):
    c = staged(raw_candles(spark, sf))
    first = c.where(F.col("date") < F.lit("2024-01-20").cast("timestamp_ntz")).withColumns({"source": F.lit("first"), "_order": F.lit(0)})
    second = c.where(F.col("date") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumns({"source": F.lit("second"), "_order": F.lit(1)})
    whole = vd.keep_first(first.unionByName(second), KEY, ["_order"])
    return vd.trim(whole, "2024-01-04", "2024-01-27").select(*KEY, "close", "source")


@query("raw_rows_to_candles", """SELECT event_type AS symbol, make_timestamp(epoch_us(ts) // 1000 * 1000) AS date, value AS open, value AS high, value AS low, value AS close, value AS volume FROM events""")
def raw_rows_to_candles(spark, sf):
    rows = ticks(spark, sf).select(
        "symbol", F.floor(epoch_us("date") / 1000).alias("ms"), *[F.col("price").cast("string").alias(c) for c in
                                                                  ("open", "high", "low", "close", "volume")]
    )
    return raw_to_candles(rows, "1min").drop("timeframe")


def _from_source(source):
    """A generator that takes the rows of the missing windows from a table."""

    def generate(_, missing):
        day = bar_of("date", "1D")
        return source.withColumn("window", day).join(missing.select("symbol", "window"), ["symbol", "window"]).drop("window")

    return generate


@query("windowed_read_or_generate", f"""WITH {sql_candles()}
SELECT symbol, date, open, high, low, close, {s6("volume", "volume")} FROM raw_1h WHERE date BETWEEN TIMESTAMP '2024-01-03 05:00:00' AND TIMESTAMP '2024-01-29 10:00:00'""")
def windowed_read_or_generate(spark, sf):
    source = staged(raw_candles(spark, sf))
    generate = _from_source(source)
    place = f"{shared_folder(spark)}/candles-{uuid.uuid4().hex}"
    now = datetime(2024, 1, 28, 12)
    symbols = source.select("symbol").distinct()
    # a few windows of one symbol are there already; the second read fills the others, and the days from the 28th stay unstored
    sinks.read_or_generate(
        spark, place, "ohlcv", datetime(2024, 1, 8), datetime(2024, 1, 11, 23), generate, vd.CANDLES, now=now,
        series=symbols.where("symbol = 'click'"),
    )
    out = sinks.read_or_generate(
        spark, place, "ohlcv", datetime(2024, 1, 3, 5), datetime(2024, 1, 29, 10), generate, vd.CANDLES, now=now, series=symbols,
    )
    return out.select(*KEY, "open", "high", "low", "close", (F.round("volume", 6) + F.lit(0.0)).alias("volume"))


@query("checked_table_write", f"""WITH {sql_candles()} SELECT symbol, timeframe, date, open, high, low, close, {s6("volume", "volume")} FROM c_1h""")
def checked_table_write(spark, sf):
    path = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    out = sinks.write_checked(candles(spark, sf), path, vd.CANDLES)
    return out.select("symbol", "timeframe", *["date", "open", "high", "low", "close"], (F.round("volume", 6) + F.lit(0.0)).alias("volume"))


@query("generated_windows", """
WITH s AS (SELECT DISTINCT event_type AS symbol FROM events),
w AS (SELECT symbol, unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-29', INTERVAL 1 DAY)) AS start FROM s)
SELECT symbol, start, start + INTERVAL 1 DAY AS "end" FROM w WHERE NOT (symbol = 'click' AND start BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-11')""")
def generated_windows(spark, sf):
    """The windows a generator is asked for when some are stored already."""
    source = staged(raw_candles(spark, sf))
    asked = []

    def generate(session, missing):
        asked.append(missing)
        return _from_source(source)(session, missing)

    place = f"{shared_folder(spark)}/candles-{uuid.uuid4().hex}"
    symbols = source.select("symbol").distinct()
    read = lambda first, last, series: sinks.read_or_generate(
        spark, place, "ohlcv", first, last, generate, vd.CANDLES, now=datetime(2024, 1, 28, 12), series=series)
    read(datetime(2024, 1, 8), datetime(2024, 1, 11, 23), symbols.where("symbol = 'click'"))
    asked.clear()
    read(datetime(2024, 1, 3, 5), datetime(2024, 1, 29, 10), symbols)
    return reduce(DataFrame.unionByName, asked).select("symbol", "start", "end")


@query("hook_after_read", f"""WITH {sql_candles()}
SELECT symbol, date, {s6("high - low", "width")} FROM raw_1h WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 10:00:00' AND high > low""")
def hook_after_read(spark, sf):
    source = staged(raw_candles(spark, sf))
    out = sinks.read_or_generate(
        spark, f"{shared_folder(spark)}/candles-{uuid.uuid4().hex}", "ohlcv", datetime(2024, 1, 5), datetime(2024, 1, 19, 10),
        _from_source(source), vd.CANDLES, now=datetime(2024, 1, 28), series=source.select("symbol").distinct(),
        after_read=lambda rows: rows.where("high > low").withColumn("width", F.col("high") - F.col("low")),
    )
    return out.select(*KEY, (F.round("width", 6) + F.lit(0.0)).alias("width"))


@query("single_stored_result", f"""WITH {sql_candles()} SELECT symbol, date, close FROM raw_1h WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 10:00:00'""")
def single_stored_result(spark, sf):
    """Generated once; the second read takes what is stored and needs no generator."""
    schema = T.StructType([f for f in vd.CANDLES if f.name in ("symbol", "date", "close")])
    path, span = f"{shared_folder(spark)}/one-{uuid.uuid4().hex}", (datetime(2024, 1, 5), datetime(2024, 1, 19, 10))

    def generate(_, start, end):
        return raw_candles(spark, sf).where(F.col("date").between(*[F.lit(t).cast("timestamp_ntz") for t in (start, end)]))

    sinks.read_or_generate_one(spark, path, *span, generate, schema, now=datetime(2024, 1, 28))
    return sinks.read_or_generate_one(spark, path, *span, None, schema, now=datetime(2024, 1, 28))


@query("compacted_rows", f"""WITH RECURSIVE {sql_candles()},
o AS (SELECT symbol, date_trunc('day', date) AS start, count(*) * 100 AS bytes, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', date)) AS k
  FROM raw_1h GROUP BY 1, 2),
walk AS (SELECT symbol, start, k, bytes AS size, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.symbol, o.start, o.k, CASE WHEN w.size >= 6000 OR o.start <> w.start + INTERVAL 1 DAY THEN o.bytes ELSE w.size + o.bytes END,
    w.batch + CASE WHEN w.size >= 6000 OR o.start <> w.start + INTERVAL 1 DAY THEN 1 ELSE 0 END FROM walk w JOIN o ON o.symbol = w.symbol AND o.k = w.k + 1),
b AS (SELECT *, count(*) OVER (PARTITION BY symbol, batch) AS files FROM walk)
SELECT r.symbol, r.date, r.close, CASE WHEN files > 1 THEN batch END AS batch FROM raw_1h r JOIN b ON b.symbol = r.symbol AND b.start = date_trunc('day', r.date)""")
def compacted_rows(spark, sf):
    """A file a day and symbol, merged by size; rows come from merged batches and from the files that stay alone."""
    rows = raw_candles(spark, sf).select(*KEY, "close").withColumn("start", F.date_trunc("day", "date").cast("timestamp_ntz"))
    rows = staged(rows)
    root = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    keyed = rows.withColumns({"series": F.col("symbol"), "day": F.date_format("start", "yyyy-MM-dd")}).drop("start")
    keyed.repartition("series", "day").write.partitionBy("series", "day").parquet(root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select(
        "path", F.regexp_extract("path", "series=([^/]+)", 1).alias("symbol"),
        F.regexp_extract("path", "day=([^/]+)", 1).cast("timestamp_ntz").alias("start"))
    sizes = rows.groupBy("symbol", "start").agg((F.count(F.lit(1)) * 100).alias("bytes"))
    manifest = staged(listed.join(sizes, ["symbol", "start"]).select(
        F.lit("ohlcv").alias("dataset"), "symbol", "start", plus_seconds("start", 86_400 - 60).alias("end"), "bytes", "path"))
    target = f"{root}-merged"
    schema = T.StructType([f for f in rows.schema if f.name != "start"])
    sinks.compact(spark, manifest, "D", 6_000, target)
    return sinks.read_compacted(spark, manifest, target, schema).select(*KEY, "close", F.col("file_batch").alias("batch"))


@query("rewritten_timeframes", f"""WITH {sql_stacked()} SELECT symbol, timeframe, date, close FROM mt
WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 10:00:00'""")
def rewritten_timeframes(spark, sf):
    """A stored table whose hours are written with a capital letter, rewritten by version and read again."""
    old = F.regexp_replace("timeframe", r"(\d+)h", "$1H")
    source = staged(stacked(spark, sf).withColumn("timeframe", old))
    place = f"{shared_folder(spark)}/old-{uuid.uuid4().hex}"

    def read():
        return sinks.read_or_generate(
            spark, place, "ohlcv", datetime(2024, 1, 5), datetime(2024, 1, 19, 10), _from_source(source), vd.CANDLES,
            now=datetime(2024, 1, 28), series=source.select("symbol").distinct())

    read()
    sinks.rewritten(spark, place, vd.CANDLES, "timeframe", normalized_timeframe("timeframe"))
    return read().select("symbol", "timeframe", "date", "close")


@query("sample_batches", f"""WITH {sql_candles()},
p AS (SELECT symbol, date, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM c_1h)
SELECT count(*) AS samples, CAST(sum(len(x)) AS BIGINT) AS cells, true AS small_files FROM p WHERE len(x) = 6""")
def sample_batches(spark, sf):
    """Samples with array columns, at most 500 to a file, as they are read back."""
    def gather(rows, w):
        return rows.withColumn("x", F.collect_list("close").over(w.rowsBetween(-5, 0)))

    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    samples = framed(candles(spark, sf).select(*KEY, "bar", "close"), gather, before=5, keys=("symbol",)).where(F.size("x") == 6)
    sinks.write_batches(samples.select(*KEY, "x"), path, 500)
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("x")).alias("cells"))
    return per_file.agg(F.sum("n").alias("samples"), F.sum("cells").alias("cells"), (F.max("n") <= 500).alias("small_files"))


# --- periods and forecasts -------------------------------------------------------------------------------


@query("overlapped_periods", f"""WITH {sql_daily()},
r AS (SELECT symbol, min(date) AS s, max(date) AS e FROM raw_d GROUP BY 1),
f AS (SELECT *, date_trunc('year', s) + INTERVAL (CAST(ceil(epoch(s - date_trunc('year', s)) / 86400 / 45.0) AS INT) * 45) DAY AS first FROM r)
SELECT symbol, unnest(generate_series(first, e - INTERVAL 90 DAY, INTERVAL 45 DAY)) AS period_start, unnest(generate_series(first, e - INTERVAL 90 DAY, INTERVAL 45 DAY)) + INTERVAL 90 DAY AS period_end FROM f""")
def overlapped_periods(spark, sf):
    spans = daily_raw(spark, sf).groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return sp.overlapped_periods(spans).select("symbol", "period_start", "period_end")


@query("random_cached_period", f"""WITH {SQL_MANIFEST},
r AS (SELECT symbol, min(start) AS start, CAST(floor((epoch(max("end")) - epoch(min(start)) - 5 * 86400) / 3600) AS BIGINT) AS room FROM m GROUP BY 1),
p AS (SELECT symbol, start + to_hours(CAST('0x' || md5(symbol || '|7')[1:8] AS BIGINT) % (room + 1)) AS period_start FROM r WHERE room >= 0)
SELECT symbol, period_start, period_start + INTERVAL 5 DAY AS period_end FROM p""")
def random_cached_period(spark, sf):
    return sp.random_periods(mf.cache_summary(_manifest(spark, sf)), days=5, seed=7)


@query("range_needed_for_now", f"""SELECT event_type AS symbol, max(ts) - INTERVAL (140 * 7) DAY AS start, max(ts) + INTERVAL 300 MINUTE AS "end" FROM events GROUP BY 1""")
def range_needed_for_now(spark, sf):
    start, end = sp.range_for_now(F.col("now"))
    return ticks(spark, sf).groupBy("symbol").agg(F.max("date").alias("now")).select("symbol", start.alias("start"), end.alias("end"))


@query("gaps_for_now", f"""WITH {SQL_MANIFEST},
nw AS (SELECT event_type AS symbol, max(ts) AS now FROM events GROUP BY 1),
days AS (SELECT symbol, unnest(generate_series(date_trunc('day', now - INTERVAL 21 DAY), date_trunc('day', now + INTERVAL 300 MINUTE), INTERVAL 1 DAY)) AS ws FROM nw),
lacking AS (SELECT symbol, ws FROM days w WHERE ws + INTERVAL 1 DAY - INTERVAL 1 MINUTE < (SELECT max(now) FROM nw)
  AND NOT EXISTS (SELECT 1 FROM m f WHERE f.symbol = w.symbol AND f.start <= w.ws AND f."end" >= w.ws + INTERVAL 1 DAY - INTERVAL 1 MINUTE)),
runs AS (SELECT *, ws - INTERVAL (row_number() OVER (PARTITION BY symbol ORDER BY ws)) DAY AS i FROM lacking)
SELECT symbol, min(ws) AS start, max(ws) + INTERVAL 1 DAY - INTERVAL 1 MINUTE AS "end", count(*) AS windows FROM runs GROUP BY symbol, i""")
def gaps_for_now(spark, sf):
    nows = ticks(spark, sf).groupBy("symbol").agg(F.max("date").alias("now"))
    return sp.gaps_for_now(_manifest(spark, sf), nows, weeks=3)


@query("forecast_reconstruction", f"""WITH RECURSIVE {sql_candles()},
b AS (SELECT symbol, date, high, low, high AS mean_high, low AS mean_low, greatest(1.0, high - low) AS std_high, greatest(1.0, high - low) AS std_low, bar FROM c_1h),
w AS (SELECT symbol, date, 0 AS step, high, low, mean_high, mean_low, std_high, std_low, bar FROM b
  UNION ALL SELECT w.symbol, w.date, w.step + 1, n.h, n.l, n.mh, n.ml, sqrt((255 * w.std_high * w.std_high + (n.h - n.mh) * (n.h - n.mh)) / 256), sqrt((255 * w.std_low * w.std_low + (n.l - n.ml) * (n.l - n.ml)) / 256), w.bar
  FROM w, LATERAL (SELECT h, l, (w.mean_high * 255 + h) / 256 AS mh, (w.mean_low * 255 + l) / 256 AS ml FROM (SELECT w.mean_high + w.std_high * ((w.step + 1) * 0.1) AS h, w.mean_low + w.std_low * (-(w.step + 1) * 0.05) AS l)) n WHERE w.step < 4)
SELECT symbol, date, step, {s6("high + 1e-9", "high")}, {s6("low + 1e-9", "low")}, {s6("mean_high + 1e-9", "mean_high")}, {s6("std_low + 1e-9", "std_low")} FROM w""")
def forecast_reconstruction(spark, sf):
    spread = F.greatest(F.lit(1.0), F.col("high") - F.col("low"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(i * 0.1).alias("n_high"), F.lit(-i * 0.05).alias("n_low")) for i in range(1, 5)])
    rows = candles(spark, sf).select(
        *KEY, "high", "low", F.col("high").alias("mean_high"), F.col("low").alias("mean_low"), spread.alias("std_high"),
        spread.alias("std_low"), steps.alias("steps"),
    )
    # shares of 256 end in a decimal 5, which the engines round differently: move them off the middle
    out = sp.reconstruct_forecast(rows)
    return out.select(*KEY, "step", *[(F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c) for c in ("high", "low", "mean_high", "std_low")])


SAMPLE_LEVELS = [sp.Level("double", "1h", 6), sp.Level("trigger", "1h", 8), sp.Level("pattern", "4h", 6), sp.Level("structure", "4h", 5)]
SAMPLE_COLUMNS = ["open", "high", "low", "close", "volume", "rsi", "bbands_m", "rel_close", "volume_atr"]
SAMPLE_COUNT, SAMPLE_SEED, SAMPLE_RATE = 30, 11, 0.6


def _sample_frame_sql(tf: str) -> str:
    """CTE `f_<tf>`: the sample columns and ATR of one timeframe."""
    w = "PARTITION BY symbol ORDER BY bar"
    return f"""{sql_atr(f"fa_{tf}", f"c_{tf}", 14)}, {sql_ewm(f"fe_{tf}", f"fa_{tf}", "volume", 1 / 14, 14, "rma")},
fs_{tf} AS (SELECT *, greatest(x, 0 * x) AS up, greatest(-x, 0 * x) AS down FROM (SELECT *, close - lag(close) OVER ({w}) AS x FROM fe_{tf})),
{sql_ewm(f"fg_{tf}", f"fs_{tf}", "up", 1 / 14, 14, "gain")}, {sql_ewm(f"fl_{tf}", f"fg_{tf}", "down", 1 / 14, 14, "loss")},
f_{tf} AS (SELECT symbol, bar, date, open, high, low, close, volume, 100 * gain / nullif(gain + loss, 0) AS rsi,
    CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END AS bbands_m, close / nullif(atr, 0) AS rel_close, volume / nullif(rma, 0) AS volume_atr, atr
  FROM fl_{tf} WINDOW f AS ({w} ROWS 4 PRECEDING))"""


def _samples_sql() -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in SAMPLE_COLUMNS)
    length = sum(v.bars * {"1h": 3600, "4h": 14_400}[v.timeframe] for v in SAMPLE_LEVELS)
    ends, back, parts = [], 0, []
    for v in SAMPLE_LEVELS:
        width = {"1h": 3600, "4h": 14_400}[v.timeframe]
        ends.append(f"CAST(floor((t - {back}) / {width}) AS BIGINT) AS bar_{v.name}")
        back += width * v.bars
        parts.append(f"(SELECT count(*) FROM f_{v.timeframe} f WHERE f.symbol = d.symbol AND f.bar BETWEEN bar_{v.name} - {v.bars - 1} AND bar_{v.name} AND {whole} AND atr IS NOT NULL) = {v.bars}")
    slices = " UNION ALL ".join(
        f"SELECT k.symbol, k.draw, '{v.name}' AS level, f.* EXCLUDE (symbol) FROM kept k JOIN f_{v.timeframe} f ON f.symbol = k.symbol "
        f"AND f.bar BETWEEN bar_{v.name} - {v.bars - 1} AND bar_{v.name}" for v in SAMPLE_LEVELS)
    as_float = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    closes = ", ".join(
        f"round(sum({as_float('(close + price_shift) * price_scale / 20')}) FILTER (level = '{v.name}'), 3) + 0.0 AS closes_{v.name}" for v in SAMPLE_LEVELS)
    label = {"min_low": "(min_low + price_shift) * price_scale / 20", "max_high": "(max_high + price_shift) * price_scale / 20",
             "long_profit": "long_profit * price_scale / 20", "short_drawdown": "short_drawdown * price_scale / 20", "long_risk": "long_risk"}
    future = ", ".join(f"round(sum({as_float(x)}), 3) + 0.0 AS future_{c}" for c, x in label.items())
    return f"""WITH RECURSIVE {sql_stacked()}, {_sample_frame_sql("1h")}, {_sample_frame_sql("4h")}, a AS (SELECT * FROM fa_1h), {SQL_EXTREMES}, {SQL_DRAWDOWN}, {SQL_PROFIT},
lb AS (SELECT symbol, bar, date, long_signal, short_signal, min_low, max_high, max_high - worst_long_open AS long_profit, worst_short_open - min_low AS short_profit,
    long_risk, short_risk, long_drawdown, short_drawdown FROM s_short),
bounds AS (SELECT symbol, max(s) + INTERVAL 4 HOUR AS s, min(e) - INTERVAL 20 HOUR AS e FROM (
    SELECT symbol, min(date) AS s, max(date) AS e FROM f_1h WHERE {whole} GROUP BY 1 UNION ALL SELECT symbol, min(date), max(date) FROM f_4h WHERE {whole} GROUP BY 1
    UNION ALL SELECT symbol, min(date), max(date) FROM lb WHERE long_signal IS NOT NULL AND short_signal IS NOT NULL GROUP BY 1) GROUP BY symbol HAVING count(*) = 3),
rooms AS (SELECT *, CAST(epoch(e) - epoch(s) - {length} AS BIGINT) AS room FROM bounds),
draws AS (SELECT symbol, e, room, unnest(range(1, 1001)) AS draw FROM rooms WHERE room > 0),
ends AS (SELECT symbol, draw, CAST(epoch(e) AS BIGINT) - CAST('0x' || md5(symbol || '|' || draw || '|{SAMPLE_SEED}')[1:8] AS BIGINT) % room AS t FROM draws),
d AS (SELECT *, {", ".join(ends)}, CAST(floor((t - 1) / 3600) AS BIGINT) + 1 AS at FROM ends),
ok AS (SELECT d.*, long_signal, short_signal, long_signal <> 0 OR short_signal <> 0 AS act, row_number() OVER (PARTITION BY d.symbol ORDER BY draw) AS k
  FROM d JOIN lb ON lb.symbol = d.symbol AND lb.bar = d.at WHERE {" AND ".join(parts)}),
walk AS (SELECT symbol, 0 AS k, 0 AS yes, 0 AS no, false AS taken FROM rooms UNION ALL
  SELECT o.symbol, o.k, w.yes + (x.take AND o.act)::INT, w.no + (x.take AND NOT o.act)::INT, x.take FROM walk w JOIN ok o ON o.symbol = w.symbol AND o.k = w.k + 1,
    LATERAL (SELECT o.act OR (w.yes > 0 AND w.no / w.yes <= {1 / SAMPLE_RATE - 1!r}) AS take) x WHERE w.yes + w.no < {SAMPLE_COUNT}),
kept AS (SELECT o.* FROM ok o JOIN walk w ON w.symbol = o.symbol AND w.k = o.k AND w.taken),
sl AS ({slices}),
sc AS (SELECT k.symbol, k.draw, 1 / (SELECT avg(atr) FROM sl WHERE sl.symbol = k.symbol AND sl.draw = k.draw AND level = 'trigger') AS price_scale,
    -(SELECT arg_max(close, date) FROM sl WHERE sl.symbol = k.symbol AND sl.draw = k.draw AND level = 'double') AS price_shift,
    1 / (SELECT avg(volume) FROM sl WHERE sl.symbol = k.symbol AND sl.draw = k.draw) AS volume_scale FROM kept k),
xs AS (SELECT symbol, draw, {closes}, round(sum({as_float("volume * volume_scale")}), 3) + 0.0 AS volumes, round(sum({as_float("(rsi - 50) / 8")}), 3) + 0.0 AS rsis
  FROM sl JOIN sc USING (symbol, draw) GROUP BY 1, 2),
ys AS (SELECT symbol, draw, count(*) AS bars, {future} FROM (SELECT k.symbol, k.draw, l.* EXCLUDE (symbol) FROM kept k JOIN lb l ON l.symbol = k.symbol AND l.bar BETWEEN k.at AND k.at + 9)
  JOIN sc USING (symbol, draw) GROUP BY 1, 2)
SELECT k.symbol, k.draw, make_timestamp(t * 1000000) AS end_double, round(k.long_signal, 5) + 0.0 AS long_signal, round(k.short_signal, 5) + 0.0 AS short_signal, act AS is_actionable, xs.* EXCLUDE (symbol, draw), ys.* EXCLUDE (symbol, draw)
FROM kept k JOIN xs USING (symbol, draw) JOIN ys USING (symbol, draw)"""


@query("random_training_samples", _samples_sql())
def random_training_samples(spark, sf):
    mt = staged(stacked(spark, sf))
    framed_tf = {tf: staged(sp.frame_with_indicators(mt.where(F.col("timeframe") == tf), 14)) for tf in ("1h", "4h")}
    labels = staged(
        add_long_short_profit(framed_tf["1h"].select("symbol", "timeframe", "bar", "date", "high", "low", "close", "atr"),
                              horizon=H, delay=D, quantiles=Q, max_risk=RISK, trigger_tf="1h")
    )
    out = sp.random_samples(
        {v.name: framed_tf[v.timeframe] for v in SAMPLE_LEVELS}, labels, SAMPLE_LEVELS, SAMPLE_COLUMNS, SAMPLE_COUNT, SAMPLE_SEED, "1h", 10,
        SAMPLE_RATE)

    def total(name, i):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x[i].cast("double"))

    def r3(x):
        return F.round(x, 3) + F.lit(0.0)

    every = [v.name for v in SAMPLE_LEVELS]
    volume, rsi = (sum((total(n, SAMPLE_COLUMNS.index(c)) for n in every), F.lit(0.0)) for c in ("volume", "rsi"))
    names = ("min_low", "max_high", "long_profit", "short_drawdown", "long_risk")
    return out.select(
        "symbol", "draw", "end_double", (F.round("long_signal", 5) + F.lit(0.0)).alias("long_signal"),
        (F.round("short_signal", 5) + F.lit(0.0)).alias("short_signal"), "is_actionable",
        *[r3(total(n, SAMPLE_COLUMNS.index("close"))).alias(f"closes_{n}") for n in every], r3(volume).alias("volumes"), r3(rsi).alias("rsis"),
        F.size("future").alias("bars"), *[r3(total("future", sp.LABELS.index(c))).alias(f"future_{c}") for c in names],
    )


@query("scale_parameters", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}
SELECT symbol, date_trunc('day', date) AS day, round(1 / nullif(avg(atr), 0), 8) + 0.0 AS price_scale, -last(close ORDER BY date) AS price_shift,
  round(1 / nullif(avg(volume), 0), 8) + 0.0 AS volume_scale FROM a GROUP BY 1, 2""")
def scale_parameters(spark, sf):
    rows = add_atr(candles(spark, sf), 14).withColumn("day", F.date_trunc("day", "date").cast("timestamp_ntz"))
    out = sp.scale_parameters(rows, ["symbol", "day"])
    return out.select(
        "symbol", "day", (F.round("price_scale", 8) + F.lit(0.0)).alias("price_scale"), "price_shift",
        (F.round("volume_scale", 8) + F.lit(0.0)).alias("volume_scale"),
    )


@query("candles_with_indicators", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {sql_ewm("e", "a", "volume", 1 / 14, 14, "rma")},
b AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS m FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))
SELECT symbol, date, {s6("m", "bbands_m")}, {s6("close / nullif(atr, 0)", "rel_close")}, {s6("volume / nullif(rma, 0)", "volume_atr")} FROM b""")
def candles_with_indicators(spark, sf):
    out = sp.frame_with_indicators(candles(spark, sf), 14)
    return out.select(*KEY, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("bbands_m", "rel_close", "volume_atr")])
