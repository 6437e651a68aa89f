"""Projections, filters, validation, grids, set operations, sorts, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidemark.functions import ladder as ld
from tidemark.functions import scalars as sc
from tidemark.functions.clock import plus_seconds
from tidemark.operators import similarity as sim
from tidemark.operators import validate as vd
from tidemark.operators.resample import resample
from tidemark.operators.smoothing import add_atr
from tidemark.queries import query
from tidemark.queries.views import (
    SQL_LADDER,
    SQL_SHIPPED,
    candles,
    daily,
    daily_raw,
    ntz,
    r6,
    raw_candles,
    s6,
    shipped,
    sql_atr,
    sql_candles,
    sql_daily,
    sql_stacked,
    stacked,
    table,
    ticks,
)
from tidemark.session import staged

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY date"


# --- filters ---------------------------------------------------------------------------------------------


@query("single_timeframe", f"WITH {sql_stacked()} SELECT symbol, date, close FROM mt WHERE timeframe = '4h'")
def single_timeframe(spark, sf):
    return vd.one_timeframe(stacked(spark, sf), "4h").select(*KEY, "close")


@query("higher_or_equal_timeframes", f"""WITH {sql_stacked()}, {SQL_LADDER}
SELECT symbol, timeframe, date, close FROM mt JOIN ladder USING (timeframe) WHERE rank >= (SELECT rank FROM ladder WHERE timeframe = '4h')""")
def higher_or_equal_timeframes(spark, sf):
    least = list(ld.TF_MINUTES).index("4h")
    return stacked(spark, sf).where(ld.rank_of("timeframe") >= least).select("symbol", "timeframe", "date", "close")


@query("lower_or_equal_timeframes", f"""WITH {sql_stacked()}, {SQL_LADDER}
SELECT symbol, timeframe, date, close FROM mt JOIN ladder USING (timeframe) WHERE rank <= (SELECT rank FROM ladder WHERE timeframe = '4h')""")
def lower_or_equal_timeframes(spark, sf):
    most = list(ld.TF_MINUTES).index("4h")
    return stacked(spark, sf).where(ld.rank_of("timeframe") <= most).select("symbol", "timeframe", "date", "close")


@query("trim_range", f"""WITH {sql_candles()} SELECT symbol, date, close FROM c_1h
WHERE date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:00:00'""")
def trim_range(spark, sf):
    rows = vd.trim(candles(spark, sf), "2024-01-10", "2024-01-12 06:00:00")
    return vd.require_unique(rows, KEY).select(*KEY, "close")


@query("range_scan", """SELECT event_id, event_type, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-07' AND TIMESTAMP '2024-01-09'""")
def range_scan(spark, sf):
    from tidemark.sources.readers import read_range

    rows = read_range(spark, [f"{sf}/events.parquet"], "2024-01-07", "2024-01-09", time="ts")
    return rows.select("event_id", "event_type", "ts", "value")


@query("last_complete_rows", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)},
v AS (SELECT symbol, date, atr, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM a WHERE atr IS NOT NULL)
SELECT symbol, date, {s6("atr", "atr")} FROM v WHERE k <= 100 AND n >= 100""")
def last_complete_rows(spark, sf):
    rows = add_atr(candles(spark, sf), 14).select(*KEY, r6("atr").alias("atr"))
    return vd.last_complete_rows(staged(rows), 100)


@query("common_complete_range", f"""WITH {sql_stacked()}, {sql_atr("a", "c_1h", 14)}, {sql_atr("b", "c_4h", 14)},
x AS (SELECT symbol, min(date) AS s, max(date) AS e FROM a WHERE atr IS NOT NULL GROUP BY 1),
y AS (SELECT symbol, min(date) AS s, max(date) AS e FROM b WHERE atr IS NOT NULL GROUP BY 1)
SELECT x.symbol, greatest(x.s, y.s) AS start, least(x.e, y.e) AS "end" FROM x JOIN y USING (symbol) WHERE greatest(x.s, y.s) <= least(x.e, y.e)""")
def common_complete_range(spark, sf):
    mt = staged(add_atr(stacked(spark, sf), 14))
    return vd.common_complete_range({tf: mt.where(F.col("timeframe") == tf) for tf in ("1h", "4h")})


@query("offset_limit_slice", f"""WITH {sql_candles()} SELECT symbol, date, close FROM c_1h ORDER BY date, symbol LIMIT 50 OFFSET 100""")
def offset_limit_slice(spark, sf):
    return candles(spark, sf).select(*KEY, "close").orderBy("date", "symbol").offset(100).limit(50)


@query("top_bottom_rows", f"""WITH {sql_candles()}
SELECT * FROM (SELECT symbol, date, volume, 'most' AS "end" FROM c_1h ORDER BY volume DESC, date, symbol LIMIT 10)
UNION ALL SELECT * FROM (SELECT symbol, date, volume, 'least' FROM c_1h ORDER BY volume, date, symbol LIMIT 10)""")
def top_bottom_rows(spark, sf):
    rows = candles(spark, sf).select(*KEY, "volume")
    return sim.top_and_bottom(rows, "volume", 10, ["date", "symbol"])


@query("sorted_stack", f"WITH {sql_stacked()} SELECT symbol, timeframe, date, close FROM mt ORDER BY date, symbol, timeframe")
def sorted_stack(spark, sf):
    return stacked(spark, sf).select("symbol", "timeframe", "date", "close").orderBy("date", "symbol", "timeframe")


# --- grids and gaps --------------------------------------------------------------------------------------

SQL_GRID = """
g AS (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL '1 DAY')) AS date FROM raw_d GROUP BY symbol),
m AS (SELECT symbol, date FROM g ANTI JOIN raw_d USING (symbol, date))"""


@query("missing_bars", f"WITH {sql_daily()}, {SQL_GRID} SELECT symbol, date FROM m")
def missing_bars(spark, sf):
    return vd.missing_bars(staged(daily_raw(spark, sf)), "1D").select(*KEY)


@query("excess_rows", "SELECT event_id AS seq FROM events WHERE ts <> time_bucket(INTERVAL 1 HOUR, ts)")
def excess_rows(spark, sf):
    return vd.excess_rows(ticks(spark, sf), "1h").select("seq")


SQL_RUNS = """
r AS (SELECT symbol, date, date - INTERVAL (row_number() OVER (PARTITION BY symbol ORDER BY date)) DAY AS island FROM m)"""


@query("series_gaps", f"""WITH {sql_daily()}, {SQL_GRID}, {SQL_RUNS}
SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS bars FROM r GROUP BY symbol, island""")
def series_gaps(spark, sf):
    missing = staged(vd.missing_bars(staged(daily_raw(spark, sf)), "1D"))
    return vd.gap_runs(missing, "1D")


@query("series_gap_counts", f"""WITH {sql_daily()}, {SQL_GRID}
SELECT d.symbol, count(m.date) AS missing, count(m.date) > 0 AS has_gap FROM (SELECT DISTINCT symbol FROM raw_d) d LEFT JOIN m USING (symbol) GROUP BY 1""")
def series_gap_counts(spark, sf):
    days = staged(daily_raw(spark, sf))
    counts = vd.missing_bars(days, "1D").groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))
    out = days.select("symbol").distinct().join(counts, "symbol", "left")
    return out.select("symbol", F.coalesce("missing", F.lit(0)).alias("missing"), (F.coalesce("missing", F.lit(0)) > 0).alias("has_gap"))


@query("times_outside_valid_set", f"""WITH {sql_daily()}
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT DISTINCT date AS l_shipdate FROM raw_d) v USING (l_shipdate)""")
def times_outside_valid_set(spark, sf):
    valid = daily_raw(spark, sf).select(F.col("date").alias("l_shipdate")).distinct()
    lines = table(spark, sf, "lineitem").withColumn("l_shipdate", ntz("l_shipdate"))
    return vd.keys_outside(lines, valid, ["l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("random_gaps", f"""WITH {sql_candles()},
b AS (SELECT symbol, date, close, bar - min(bar) OVER s AS place, CAST(greatest(11, ceil((max(bar) OVER s - min(bar) OVER s + 1) / 6)) AS BIGINT) AS width
  FROM c_1h WINDOW s AS (PARTITION BY symbol)),
d AS (SELECT *, md5(symbol || '|' || (place // width) || '|7') AS m FROM b),
g AS (SELECT *, CAST('0x' || m[1:8] AS BIGINT) % 10 + 1 AS length, CAST('0x' || m[9:16] AS BIGINT) AS second FROM d)
SELECT symbol, date, close FROM g WHERE place % width < second % (width - length) OR place % width >= second % (width - length) + length""")
def random_gaps(spark, sf):
    return vd.with_random_gaps(staged(candles(spark, sf)), "1h", per_series=6, longest=10, seed=7).select(*KEY, "close")


# --- keys and sets ---------------------------------------------------------------------------------------


@query("symbol_mapping", f"""WITH {sql_candles()}
SELECT CASE symbol WHEN 'click' THEN 'CLK/USD' WHEN 'view' THEN 'VIE/USD' ELSE symbol END AS symbol, date, close FROM c_1h""")
def symbol_mapping(spark, sf):
    names = spark.createDataFrame([("click", "CLK/USD"), ("view", "VIE/USD")], "symbol string, name string")
    return vd.mapped_symbols(candles(spark, sf), names).select(*KEY, "close")


@query("duplicate_keys", "SELECT o_orderpriority AS symbol, o_orderdate AS date, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), ntz("o_orderdate").alias("date"))
    return vd.duplicate_keys(rows, KEY)


@query("keep_first_per_key", """SELECT o_orderpriority AS symbol, o_orderdate AS date, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2""")
def keep_first_per_key(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), ntz("o_orderdate").alias("date"), "o_orderkey"
    )
    return vd.keep_first(rows, KEY, ["o_orderkey"])


@query("concat_frames", f"""WITH {sql_daily()}, {SQL_SHIPPED}
SELECT symbol, date, high, low, close, volume FROM raw_d UNION ALL SELECT symbol, date, high, low, NULL, volume FROM shipped""")
def concat_frames(spark, sf):
    left = daily_raw(spark, sf).select(*KEY, "high", "low", "close", "volume")
    return vd.concat(left, shipped(spark, sf))


@query("grid_difference", f"""WITH {sql_daily()}, {SQL_SHIPPED}
SELECT DISTINCT date FROM shipped EXCEPT SELECT DISTINCT date FROM raw_d""")
def grid_difference(spark, sf):
    return shipped(spark, sf).select("date").distinct().exceptAll(daily_raw(spark, sf).select("date").distinct())


@query("key_intersection", f"""WITH {sql_daily()}, {SQL_SHIPPED}
SELECT symbol, date, volume FROM shipped SEMI JOIN (SELECT DISTINCT date FROM raw_d) v USING (date)""")
def key_intersection(spark, sf):
    days = daily_raw(spark, sf).select("date").distinct()
    return shipped(spark, sf).join(days, "date", "left_semi").select(*KEY, "volume")


@query("key_exclusion", f"""WITH {sql_daily()}, {SQL_SHIPPED}
SELECT symbol, date, volume FROM shipped ANTI JOIN (SELECT DISTINCT date FROM raw_d) v USING (date)""")
def key_exclusion(spark, sf):
    days = daily_raw(spark, sf).select("date").distinct()
    return shipped(spark, sf).join(days, "date", "left_anti").select(*KEY, "volume")


@query("left_join_on_date", f"""WITH {sql_daily()}, {SQL_SHIPPED}
SELECT s.symbol, s.date, s.volume, d.close FROM shipped s LEFT JOIN (SELECT date, max(close) AS close FROM raw_d GROUP BY 1) d ON s.date = d.date""")
def left_join_on_date(spark, sf):
    days = daily_raw(spark, sf).groupBy("date").agg(F.max("close").alias("close"))
    return shipped(spark, sf).join(days, "date", "left").select(*KEY, "volume", "close")


@query("table_date_span", f"WITH {sql_stacked()} SELECT timeframe, min(date) AS start, max(date) AS \"end\", count(*) AS n FROM mt GROUP BY 1")
def table_date_span(spark, sf):
    return stacked(spark, sf).groupBy("timeframe").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n")
    )


@query("schema_conform", f"WITH {sql_candles()} SELECT symbol, timeframe, date, open, high, low, close, {s6('volume', 'volume')} FROM c_1h")
def schema_conform(spark, sf):
    text = candles(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("open", "high", "low", "close")})
    out = vd.checked(text, vd.CANDLES)
    return out.withColumn("volume", r6("volume"))


@query("disallowed_null_columns", f"""WITH {sql_daily()}, {SQL_SHIPPED},
u AS (SELECT high, low, close, volume FROM raw_d UNION ALL SELECT high, low, NULL, volume FROM shipped)
SELECT unnest(list_filter(['close', 'high', 'low', 'volume'], lambda c: CASE c WHEN 'close' THEN a WHEN 'high' THEN b WHEN 'low' THEN d ELSE e END)) AS column_name
FROM (SELECT bool_or(close IS NULL) AS a, bool_or(high IS NULL) AS b, bool_or(low IS NULL) AS d, bool_or(volume IS NULL) AS e FROM u)""")
def disallowed_null_columns(spark, sf):
    both = vd.concat(daily_raw(spark, sf).select(*KEY, "high", "low", "close", "volume"), shipped(spark, sf))
    return spark.createDataFrame([(c,) for c in vd.null_columns(both, vd.CANDLES)], "column_name string")


@query("concat_with_empty", f"""WITH {sql_candles()} SELECT symbol, timeframe, date, open, high, low, close, {s6("volume", "volume")} FROM c_1h""")
def concat_with_empty(spark, sf):
    out = vd.concat(vd.empty(spark, vd.CANDLES), candles(spark, sf).select(*vd.CANDLES.names))
    return out.withColumn("volume", r6("volume"))


@query("keys_as_columns", f"""WITH {sql_candles()} SELECT symbol, timeframe, date, open, high, low, close, {s6("volume", "volume")}, bar AS more FROM c_1h""")
def keys_as_columns(spark, sf):
    """Keys come as text and as plain columns behind the values; they go to the front in their types, other columns to the end."""
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume", "date")]
    raw = candles(spark, sf).select(F.col("bar").alias("more"), *text, "timeframe", "symbol")
    return vd.conform(raw, vd.CANDLES, strict=False).withColumn("volume", r6("volume"))


@query("frames_with_a_timeframe_key", f"""WITH {sql_candles()}
SELECT 'keyed' AS frame, true AS rejected, count(*) AS n FROM c_1h UNION ALL SELECT 'plain', false, count(*) FROM c_1h""")
def frames_with_a_timeframe_key(spark, sf):
    rows, checked = staged(candles(spark, sf)), []
    for name, frame in (("keyed", rows), ("plain", vd.one_timeframe(rows, "1h"))):
        try:
            rejected = vd.reject_timeframe(frame) is None
        except vd.SchemaError:
            rejected = True
        checked.append(frame.agg(F.lit(name).alias("frame"), F.lit(rejected).alias("rejected"), F.count(F.lit(1)).alias("n")))
    return checked[0].unionByName(checked[1])


MIDDLES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.TimestampNTZType()), T.StructField("middle", T.DoubleType())])


@vd.with_schemas(result=MIDDLES, df=vd.CANDLES)
def middles(df):
    return df.withColumn("middle", (F.col("high") + F.col("low")) / 2)


@query("checked_function", f"""WITH {sql_candles()} SELECT symbol, date, {s6("(high + low) / 2", "middle")} FROM c_1h""")
def checked_function(spark, sf):
    """A function whose argument (prices come as text) and result are conformed to schemas by a decorator."""
    raw = candles(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("high", "low")})
    return middles(raw).withColumn("middle", r6("middle"))


@query("min_max_scaled", f"""WITH {sql_candles()}
SELECT symbol, date, {s6("2 * (close - min(close) OVER p) / nullif(max(close) OVER p - min(close) OVER p, 0) - 1", "close")} FROM c_1h WINDOW p AS (PARTITION BY symbol)""")
def min_max_scaled(spark, sf):
    rows = staged(candles(spark, sf).select(*KEY, "close"))
    return vd.min_max_scaled(rows, ["close"]).select(*KEY, r6("close").alias("close"))


# --- scalars ---------------------------------------------------------------------------------------------

SQL_RUNGS = "[5, 15, 60, 240, 1440, 10080, 43200, 172800, 525600]"


@query("floor_to_ladder", f"""SELECT event_id, CAST(coalesce(list_max(list_filter({SQL_RUNGS}, lambda r: r <= value * value)), 0) AS DOUBLE) AS rung FROM events""")
def floor_to_ladder(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", ld.floor_to_ladder(F.col("value") * F.col("value")).alias("rung"))


@query("higher_rungs", f"""WITH {sql_stacked()}
SELECT symbol, timeframe, date, CASE timeframe WHEN '1h' THEN '1D' WHEN '4h' THEN '1W' WHEN '1D' THEN '1M' ELSE '4M' END AS plus2,
  CASE timeframe WHEN '1h' THEN '1W' WHEN '4h' THEN '1M' WHEN '1D' THEN '4M' ELSE '1Y' END AS plus3 FROM mt""")
def higher_rungs(spark, sf):
    return stacked(spark, sf).select(
        "symbol", "timeframe", "date", ld.shifted_of("timeframe", 2).alias("plus2"), ld.shifted_of("timeframe", 3).alias("plus3")
    )


@query("role_timeframes", f"""WITH {sql_stacked()}
SELECT symbol, timeframe, date, CASE timeframe WHEN '1h' THEN '15min' WHEN '4h' THEN '1h' WHEN '1D' THEN '4h' ELSE '1D' END AS pattern,
  CASE timeframe WHEN '1h' THEN '5min' WHEN '4h' THEN '15min' WHEN '1D' THEN '1h' ELSE '4h' END AS trigger_tf,
  CASE timeframe WHEN '1h' THEN '4h' WHEN '4h' THEN '1D' WHEN '1D' THEN '1W' END AS anti_pattern FROM mt""")
def role_timeframes(spark, sf):
    shift, names = ld.ROLE_SHIFT, ld.CANDLE_TIMEFRAMES
    return stacked(spark, sf).select(
        "symbol", "timeframe", "date",
        ld.shifted_of("timeframe", shift["pattern"], names).alias("pattern"),
        ld.shifted_of("timeframe", shift["trigger"], names).alias("trigger_tf"),
        ld.shifted_of("timeframe", -shift["pattern"], names).alias("anti_pattern"),
    )


@query("floor_to_bar", """SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, time_bucket(INTERVAL 4 HOUR, ts) AS four_hours,
  date_trunc('day', ts) AS day, date_trunc('week', ts) AS week, date_trunc('month', ts) AS month FROM events""")
def floor_to_bar(spark, sf):
    t = ticks(spark, sf)
    return t.select(
        F.col("seq").alias("event_id"), ld.floor_to_bar("date", "15min").alias("quarter"),
        ld.floor_to_bar("date", "4h").alias("four_hours"), ld.floor_to_bar("date", "1D").alias("day"),
        ld.floor_to_bar("date", "1W").alias("week"), ld.floor_to_bar("date", "1M").alias("month"),
    )


@query("date_range_tokens", """
WITH t AS (SELECT o_orderkey, date_trunc('minute', o_orderdate) AS s, o_orderdate + INTERVAL (o_custkey) MINUTE AS e FROM orders)
SELECT o_orderkey, strftime(s, '%y-%m-%d.%H-%M') || 'T' || strftime(e, '%y-%m-%d.%H-%M') AS token, s AS start, e AS "end", date_trunc('day', e) AS end_morning FROM t""")
def date_range_tokens(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", ntz("o_orderdate").alias("s"), plus_seconds(ntz("o_orderdate"), F.col("o_custkey") * 60).alias("e")
    )
    rows = rows.withColumn("token", sc.range_token("s", "e"))
    return rows.select(
        "o_orderkey", "token", sc.range_start("token").alias("start"), sc.range_end("token").alias("end"),
        sc.morning(sc.range_end("token")).alias("end_morning"),
    )


@query("expanded_ranges", """SELECT o_orderkey, o_orderdate - INTERVAL 4 HOUR AS start, o_orderdate + INTERVAL 28 HOUR AS "end",
  o_orderdate + INTERVAL 28 HOUR > TIMESTAMP '1998-01-01' AS after_mark FROM orders""")
def expanded_ranges(spark, sf):
    date = ntz("o_orderdate")
    start, end = sc.expand_range(date, plus_seconds(date, 86_400), 4 * 3600)
    rows = table(spark, sf, "orders").select("o_orderkey", start.alias("start"), end.alias("end"))
    return rows.withColumn("after_mark", F.col("end") > F.lit("1998-01-01").cast("timestamp_ntz"))


@query("file_name_parts", """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'S' || o_custkey || '.' END || 'ohlcv.' ||
    strftime(o_orderdate, '%y-%m-%d.%H-%M') || 'T' || strftime(o_orderdate, '%y-%m-%d.23-59') || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.zip' END AS name FROM orders)
SELECT o_orderkey, CASE WHEN name NOT LIKE '%.txt' THEN coalesce(nullif(regexp_extract(name, '^(?:(\\w+)\\.)?(\\w+)\\.([\\d\\-.T]+)\\.zip$', 1), ''), 'BTCUSDT') END AS file_symbol,
  CASE WHEN name NOT LIKE '%.txt' THEN 'ohlcv' END AS file_dataset, CASE WHEN name NOT LIKE '%.txt' THEN regexp_extract(name, 'ohlcv\\.([\\d\\-.T]+)\\.zip$', 1) END AS file_range FROM n""")
def file_name_parts(spark, sf):
    date = ntz("o_orderdate")
    day = F.date_format(date, "yy-MM-dd")
    name = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("S"), F.col("o_custkey"), F.lit("."))),
        F.lit("ohlcv."), F.date_format(date, sc.DATE_TOKEN), F.lit("T"), day, F.lit(".23-59"),
        F.when(F.col("o_orderkey") % 7 == 0, ".txt").otherwise(".zip"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    out = sc.with_file_info(rows, "name", "BTCUSDT")
    return out.select("o_orderkey", "file_symbol", "file_dataset", "file_range")


@query("duration_text", """WITH d AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s // 86400 = 1 THEN '1 day ' WHEN s // 86400 > 1 THEN (s // 86400) || ' days ' ELSE '' END ||
  printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS duration FROM d""")
def duration_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sc.duration_text(F.floor("o_totalprice")).alias("duration"))


@query("series_scale_text", f"""WITH {sql_daily()},
m AS (SELECT symbol, CASE WHEN 1e9 / max(abs(close)) > 1 THEN 'x' ELSE '/' END AS mark, CASE WHEN 1e9 / max(abs(close)) > 1 THEN 1e9 / max(abs(close)) ELSE max(abs(close)) / 1e9 END AS s FROM raw_d GROUP BY 1),
z AS (SELECT *, CAST(floor(log10(s)) AS INT) AS z FROM m)
SELECT symbol, mark || CAST(floor(s / pow(10, z)) AS INT) || repeat('0', z - z // 3 * 3) || ['', 'K', 'M', 'B'][z // 3 + 1] AS scale FROM z""")
def series_scale_text(spark, sf):
    top = daily_raw(spark, sf).groupBy("symbol").agg(F.max(F.abs("close")).alias("top"))
    return top.select("symbol", sc.scale_text("top", 1e9).alias("scale"))


@query("timeframe_names", f"""WITH {sql_stacked()}
SELECT symbol, date, regexp_replace(replace(timeframe, 'h', 'H'), '\\b(\\d+)H\\b', '\\1h') AS timeframe, close FROM mt""")
def timeframe_names(spark, sf):
    rows = stacked(spark, sf).withColumn("timeframe", F.replace("timeframe", F.lit("h"), F.lit("H")))
    return rows.withColumn("timeframe", sc.normalized_timeframe("timeframe")).select(*KEY, "timeframe", "close")


@query("weekly_close_label", f"""WITH {sql_candles("1D")}
SELECT symbol, time_bucket(INTERVAL 7 DAY, date + INTERVAL 6 DAY) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY date) AS close, {s6("sum(volume)", "volume")} FROM c_1D GROUP BY 1, 2""")
def weekly_close_label(spark, sf):
    out = resample(candles(spark, sf, "1D"), ["1W"], week_close_label=True)
    return out.select(*KEY, "open", "high", "low", "close", r6("volume").alias("volume"))


@query("monthly_bars", f"""WITH {sql_daily()}
SELECT symbol, date_trunc('month', date) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY date) AS close, {s6("sum(volume)", "volume")} FROM d GROUP BY 1, 2""")
def monthly_bars(spark, sf):
    out = resample(daily(spark, sf), ["1M"])
    return out.select(*KEY, "open", "high", "low", "close", r6("volume").alias("volume"))


# --- distributions ---------------------------------------------------------------------------------------

SQL_X = f"""WITH {sql_candles()},
x AS (SELECT symbol, 'close' AS feature, close AS x FROM c_1h UNION ALL SELECT symbol, 'volume', volume FROM c_1h),
st AS (SELECT symbol, feature, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, quantile_cont(x, 0.25) AS p25,
  quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS mx FROM x GROUP BY 1, 2),
pr AS (SELECT a.feature, a.symbol AS symbol_1, b.symbol AS symbol_2, a.n AS n1, b.n AS n2 FROM st a JOIN st b ON a.feature = b.feature AND a.symbol < b.symbol),
h AS (SELECT x.symbol, x.feature, least(49, CAST(floor(coalesce((x - mn) / nullif(mx - mn, 0), 0) * 50) AS INT)) AS bin, count(*) / any_value(n) AS p FROM x JOIN st USING (symbol, feature) GROUP BY 1, 2, 3),
bn AS (SELECT unnest(range(50)) AS bin),
hh AS (SELECT pr.*, bn.bin, coalesce(a.p, 0) AS p1, coalesce(b.p, 0) AS p2 FROM pr CROSS JOIN bn
  LEFT JOIN h a ON a.feature = pr.feature AND a.symbol = symbol_1 AND a.bin = bn.bin LEFT JOIN h b ON b.feature = pr.feature AND b.symbol = symbol_2 AND b.bin = bn.bin),
js AS (SELECT feature, symbol_1, symbol_2, sqrt(greatest(0, sum(CASE WHEN p1 > 0 THEN p1 * ln(p1 / ((p1 + p2) / 2)) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * ln(p2 / ((p1 + p2) / 2)) ELSE 0 END) / 2)) AS js_divergence,
  sum(p1 * p2) / sqrt(sum(p1 * p1) * sum(p2 * p2)) AS cosine_similarity FROM hh GROUP BY 1, 2, 3),
u AS (SELECT pr.feature, symbol_1, symbol_2, n1, n2, x.x, sum((x.symbol = symbol_1)::INT) AS c1, sum((x.symbol = symbol_2)::INT) AS c2 FROM pr JOIN x ON x.feature = pr.feature AND x.symbol IN (symbol_1, symbol_2) GROUP BY 1, 2, 3, 4, 5, 6),
ec AS (SELECT *, abs(sum(c1) OVER w / n1 - sum(c2) OVER w / n2) AS gap, lead(x) OVER w - x AS width FROM u WINDOW w AS (PARTITION BY feature, symbol_1, symbol_2 ORDER BY x)),
od AS (SELECT feature, symbol_1, symbol_2, n1, n2, sum(gap * coalesce(width, 0)) AS wasserstein_distance, max(gap) AS ks_statistic FROM ec GROUP BY ALL)"""


@query("describe_by_symbol", f"""{SQL_X} SELECT symbol, feature, n, {s6("mean", "mean")}, {s6("std", "std")}, {s6("mn", "min")}, {s6("p25", "p25")},
  {s6("p50", "p50")}, {s6("p75", "p75")}, {s6("mx", "max")} FROM st""")
def describe_by_symbol(spark, sf):
    out = sim.describe(staged(sim.value_counts(sim.long_form(candles(spark, sf), ["close", "volume"]))))
    return out.select("symbol", "feature", "n", *[r6(c).alias(c) for c in sim.STATS])


@query("symbol_pairs", f"{SQL_X} SELECT feature, symbol_1, symbol_2, n1 AS n_1, n2 AS n_2 FROM pr")
def symbol_pairs(spark, sf):
    stats = staged(sim.describe(staged(sim.value_counts(sim.long_form(candles(spark, sf), ["close", "volume"])))))
    return sim.symbol_pairs(stats).select("feature", "symbol_1", "symbol_2", "n_1", "n_2")


@query("symbol_distances", f"""{SQL_X}, pv AS (SELECT *, ks_statistic * ks_statistic * n1 * n2 / (n1 + n2) AS lam FROM od)
SELECT feature, symbol_1, symbol_2, {s6("js_divergence", "js_divergence")}, {s6("cosine_similarity", "cosine_similarity")},
  {s6("wasserstein_distance", "wasserstein_distance")}, {s6("ks_statistic", "ks_statistic")},
  {s6("CASE WHEN lam = 0 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 3 + CAST(ceil(5 / sqrt(lam)) AS BIGINT)), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam))))) END", "ks_pvalue")}
FROM js JOIN pv USING (feature, symbol_1, symbol_2)""")
def symbol_distances(spark, sf):
    out = sim.compare_symbols(candles(spark, sf), ["close", "volume"])
    names = ["js_divergence", "cosine_similarity", "wasserstein_distance", "ks_statistic", "ks_pvalue"]
    return out.select("feature", "symbol_1", "symbol_2", *[r6(c).alias(c) for c in names])


@query("symbol_similarity", f"""{SQL_X},
g AS (SELECT symbol_1, symbol_2, avg(js_divergence) AS j, avg(cosine_similarity) AS c, avg(wasserstein_distance) AS w, avg(ks_statistic) AS k FROM js JOIN od USING (feature, symbol_1, symbol_2) GROUP BY 1, 2),
sc AS (SELECT symbol_1, symbol_2, (1 - j) * 0.4 + c * 0.3 + (1 - w / (SELECT max(w) FROM g)) * 0.2 + (1 - k) * 0.1 AS score FROM g)
SELECT * FROM (SELECT symbol_1, symbol_2, {s6("score", "similarity_score")}, 'most' AS "end" FROM sc ORDER BY score DESC, symbol_1, symbol_2 LIMIT 3)
UNION ALL SELECT * FROM (SELECT symbol_1, symbol_2, {s6("score")}, 'least' FROM sc ORDER BY score, symbol_1, symbol_2 LIMIT 3)""")
def symbol_similarity(spark, sf):
    score = staged(sim.symbol_similarity(sim.compare_symbols(candles(spark, sf), ["close", "volume"])))
    out = sim.top_and_bottom(score, "similarity_score", 3, ["symbol_1", "symbol_2"])
    return out.select("symbol_1", "symbol_2", r6("similarity_score").alias("similarity_score"), "end")


@query("column_stats", f"""WITH {sql_candles()}
SELECT 'close' AS name, min(close) AS min, max(close) AS max, {s6("avg(close)", "mean")}, {s6("stddev_pop(close)", "std")} FROM c_1h
UNION ALL SELECT 'high', min(high), max(high), {s6("avg(high)")}, {s6("stddev_pop(high)")} FROM c_1h""")
def column_stats(spark, sf):
    out = sim.column_stats(candles(spark, sf), ["close", "high"])
    return out.select("name", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"))


@query("blend_weight", f"""WITH {sql_candles()}
SELECT {s6("greatest(0, least(1, sum((close - low) * (high - low)) / sum((high - low) * (high - low))))", "alpha")} FROM c_1h""")
def blend_weight(spark, sf):
    return sim.blend_weight(candles(spark, sf), "high", "low", "close").select(r6("alpha").alias("alpha"))
