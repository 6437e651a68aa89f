"""As-of joins, nearest matches, first crossings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.clock import minutes_between, plus_seconds
from tidemark.operators.asof import asof_join, bar_join
from tidemark.operators.crossing import first_crossing
from tidemark.operators.smoothing import add_atr
from tidemark.plans import tops as tp
from tidemark.queries import query
from tidemark.queries.views import candles, r6, s6, sql_atr, sql_candles, sql_stacked, stacked, ticks
from tidemark.session import staged

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY date"
DAYS = 86_400


@query("asof_backward", f"""WITH {sql_stacked()}, {sql_atr("f", "c_4h", 14)}
SELECT t.event_id AS seq, t.event_type AS symbol, f.date AS bar_date, {s6("f.atr", "atr")}
FROM events t ASOF LEFT JOIN (SELECT * FROM f WHERE atr IS NOT NULL) f ON t.event_type = f.symbol AND f.date <= t.ts""")
def asof_backward(spark, sf):
    atr = add_atr(stacked(spark, sf).where("timeframe = '4h'"), 14).where("atr is not null")
    bars = atr.withColumn("bar_date", F.col("date"))
    out = bar_join(ticks(spark, sf).select("seq", "symbol", "date"), staged(bars), ["bar_date", "atr"], "4h")
    return out.select("seq", "symbol", "bar_date", r6("atr").alias("atr"))


@query("asof_forward", f"""WITH {sql_candles("4h")}
SELECT t.event_id AS seq, c.date AS bar_date, c.open FROM events t
ASOF LEFT JOIN c_4h c ON t.event_type = c.symbol AND c.date >= t.ts""")
def asof_forward(spark, sf):
    bars = candles(spark, sf, "4h").withColumn("bar_date", F.col("date"))
    out = bar_join(ticks(spark, sf).select("seq", "symbol", "date"), staged(bars), ["bar_date", "open"], "4h", direction="forward")
    return out.select("seq", "bar_date", "open")


@query("closed_candle_asof", f"""WITH {sql_stacked()}
SELECT a.symbol, a.date, b.date AS closed_bar, b.close AS closed_close FROM c_1h a
ASOF LEFT JOIN c_4h b ON a.symbol = b.symbol AND b.date <= a.date - INTERVAL '3 HOUR'""")
def closed_candle_asof(spark, sf):
    mt = staged(stacked(spark, sf))
    bars = mt.where("timeframe = '4h'").select(
        "symbol", "date", F.col("date").alias("closed_bar"), F.col("close").alias("closed_close")
    )
    anchors = mt.where("timeframe = '1h'").select(*KEY)
    return asof_join(
        anchors, bars, ["closed_bar", "closed_close"], left_time=plus_seconds("date", -3 * 3600), block_s=5 * DAYS
    )


@query("source_atr_aligned", f"""WITH {sql_stacked()}, {sql_atr("f", "c_4h", 14)}
SELECT a.symbol, a.date, {s6("f.atr", "atr")} FROM c_1h a
ASOF LEFT JOIN f ON a.symbol = f.symbol AND f.date <= a.date - INTERVAL '4 HOUR'""")
def source_atr_aligned(spark, sf):
    mt = staged(stacked(spark, sf))
    atr = add_atr(mt.where("timeframe = '4h'"), 14)
    out = asof_join(mt.where("timeframe = '1h'").select(*KEY), atr, ["atr"], left_time=plus_seconds("date", -4 * 3600))
    return out.select(*KEY, r6("atr").alias("atr"))


@query("nearest_match_left", f"""WITH {sql_candles()}
SELECT t.event_id AS seq, c.date AS matched FROM events t
ASOF LEFT JOIN c_1h c ON t.event_type = c.symbol AND c.date < t.ts""")
def nearest_match_left(spark, sf):
    bars = staged(candles(spark, sf).select("symbol", "bar", F.col("date").alias("matched")))
    out = bar_join(ticks(spark, sf).select("seq", "symbol", "date"), bars, ["matched"], "1h", allow_equal=False)
    return out.select("seq", "matched")


@query("nearest_match_right", f"""WITH {sql_candles("1D")}
SELECT t.event_id AS seq, c.date AS matched FROM events t
ASOF LEFT JOIN c_1D c ON t.event_type = c.symbol AND c.date > t.ts""")
def nearest_match_right(spark, sf):
    bars = staged(candles(spark, sf, "1D").select("symbol", "bar", F.col("date").alias("matched")))
    out = bar_join(ticks(spark, sf).select("seq", "symbol", "date"), bars, ["matched"], "1D", direction="forward", allow_equal=False)
    return out.select("seq", "matched")


def sql_cross(name, source, op, column, left):
    side = "b.date < a.date" if left else "b.date > a.date"
    pick = "max" if left else "min"
    return f"""
{name} AS (SELECT a.symbol, a.date, {pick}(b.date) AS t FROM {source} a
  JOIN {source} b ON a.symbol = b.symbol AND {side} AND b.{column} {op} a.{column} GROUP BY 1, 2)"""


@query("first_crossing_right", f"""WITH {sql_candles()}, {sql_cross("x", "c_1h", ">", "high", False)}
SELECT c.symbol, c.date, x.t AS crossing_time, n.high AS crossing_value FROM c_1h c
LEFT JOIN x ON c.symbol = x.symbol AND c.date = x.date LEFT JOIN c_1h n ON n.symbol = c.symbol AND n.date = x.t""")
def first_crossing_right(spark, sf):
    c = staged(candles(spark, sf))
    out = first_crossing(c, c, "high", "high", "gt", 3600)
    return out.select(*KEY, F.col("right_crossing_time").alias("crossing_time"), F.col("right_crossing_value").alias("crossing_value"))


@query("first_crossing_left", f"""WITH {sql_candles()}, {sql_cross("x", "c_1h", "<", "low", True)}
SELECT c.symbol, c.date, x.t AS crossing_time, n.low AS crossing_value FROM c_1h c
LEFT JOIN x ON c.symbol = x.symbol AND c.date = x.date LEFT JOIN c_1h n ON n.symbol = c.symbol AND n.date = x.t""")
def first_crossing_left(spark, sf):
    c = staged(candles(spark, sf))
    out = first_crossing(c, c, "low", "low", "lt", 3600, directions=("left",))
    return out.select(*KEY, F.col("left_crossing_time").alias("crossing_time"), F.col("left_crossing_value").alias("crossing_value"))


@query("nearest_reach", f"""WITH {sql_candles()}, {sql_cross("r", "c_1h", ">=", "high", False)}, {sql_cross("l", "c_1h", ">=", "high", True)}
SELECT c.symbol, c.date, epoch(r.t - c.date) / 60 AS right_minutes, epoch(c.date - l.t) / 60 AS left_minutes FROM c_1h c
LEFT JOIN r ON c.symbol = r.symbol AND c.date = r.date LEFT JOIN l ON c.symbol = l.symbol AND c.date = l.date""")
def nearest_reach(spark, sf):
    c = staged(candles(spark, sf))
    out = first_crossing(c, c, "high", "high", "ge", 3600, directions=("right", "left"))
    return out.select(
        *KEY,
        minutes_between("right_crossing_time", "date").alias("right_minutes"),
        minutes_between("date", "left_crossing_time").alias("left_minutes"),
    )


SQL_RUNGS = "[5, 15, 60, 240, 1440, 10080, 43200, 172800, 525600]"


def sql_extremum(source="c_1h", name="ext"):
    """CTE `name`: true extremum reach, size and sign of each bar of `source`."""
    p = name
    return f"""
{sql_cross(p + "_pr", source, ">=", "high", False)}, {sql_cross(p + "_pl", source, ">=", "high", True)},
{sql_cross(p + "_vr", source, "<=", "low", False)}, {sql_cross(p + "_vl", source, "<=", "low", True)},
{p}_m AS (SELECT c.*,
    least(coalesce(epoch(pr.t - c.date) / 60, 'infinity'::DOUBLE), coalesce(epoch(c.date - pl.t) / 60, 'infinity'::DOUBLE)) AS peak,
    least(coalesce(epoch(vr.t - c.date) / 60, 'infinity'::DOUBLE), coalesce(epoch(c.date - vl.t) / 60, 'infinity'::DOUBLE)) AS valley
  FROM {source} c
  LEFT JOIN {p}_pr pr ON c.symbol = pr.symbol AND c.date = pr.date LEFT JOIN {p}_pl pl ON c.symbol = pl.symbol AND c.date = pl.date
  LEFT JOIN {p}_vr vr ON c.symbol = vr.symbol AND c.date = vr.date LEFT JOIN {p}_vl vl ON c.symbol = vl.symbol AND c.date = vl.date),
{p}_s AS (SELECT *, coalesce(list_max(list_filter({SQL_RUNGS}, lambda r: r <= greatest(peak, valley))), 0) + 0.0 AS size FROM {p}_m),
{p} AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN peak >= valley THEN 1 ELSE -1 END AS sign FROM {p}_s)"""


@query("true_extremum", f"""WITH {sql_candles()}, {sql_extremum()}
SELECT symbol, date, CASE WHEN isinf(peak) THEN -1.0 ELSE peak END AS peak_reach,
  CASE WHEN isinf(valley) THEN -1.0 ELSE valley END AS valley_reach, CAST(size AS DOUBLE) AS size, sign FROM ext""")
def true_extremum(spark, sf):
    out = tp.add_true_extremum(staged(candles(spark, sf)), "1h")

    def finite(c):
        return F.when(F.col(c) == float("inf"), -1.0).otherwise(F.col(c))

    return out.select(
        *KEY, finite("true_peak_reach_minutes").alias("peak_reach"),
        finite("true_valley_reach_minutes").alias("valley_reach"),
        F.col("true_extremum_tf_minutes").alias("size"), F.col("extremum_sign").alias("sign"),
    )


def sql_tops(source="c_1h", name="tops"):
    """CTE `name`: peaks and valleys of `source`."""
    return f"""
{name}_h AS (SELECT *, lead(high) OVER ({W}) AS nx FROM
  (SELECT *, lag(high) OVER ({W}) AS pv FROM {source}) WHERE pv IS NULL OR pv <> high),
{name}_l AS (SELECT *, lead(low) OVER ({W}) AS nx FROM
  (SELECT *, lag(low) OVER ({W}) AS pv FROM {source}) WHERE pv IS NULL OR pv <> low),
{name} AS (SELECT symbol, date, open, high, low, close, volume, bar, 'peak' AS top_type FROM {name}_h WHERE high > pv AND high > nx
  UNION ALL SELECT symbol, date, open, high, low, close, volume, bar, 'valley' FROM {name}_l WHERE low < pv AND low < nx)"""


@query("find_tops", f"""WITH {sql_candles()}, {sql_tops()} SELECT symbol, date, high, low, top_type FROM tops""")
def find_tops(spark, sf):
    return tp.find_tops(staged(candles(spark, sf))).select(*KEY, "high", "low", "top_type")


@query("peaks_only", f"""WITH {sql_candles()}, {sql_tops()} SELECT symbol, date, high FROM tops WHERE top_type = 'peak'""")
def peaks_only(spark, sf):
    return tp.find_tops(staged(candles(spark, sf))).where(F.col("top_type") == tp.PEAK).select(*KEY, "high")


@query("valleys_only", f"""WITH {sql_candles()}, {sql_tops()} SELECT symbol, date, low FROM tops WHERE top_type = 'valley'""")
def valleys_only(spark, sf):
    return tp.find_tops(staged(candles(spark, sf))).where(F.col("top_type") == tp.VALLEY).select(*KEY, "low")


@query("tops_in_range", f"""WITH {sql_candles()}, {sql_tops()} SELECT symbol, date, top_type FROM tops
WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'""")
def tops_in_range(spark, sf):
    inside = F.col("date").between(
        F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12 12:00:00").cast("timestamp_ntz")
    )
    return tp.find_tops(staged(candles(spark, sf))).where(inside).select(*KEY, "top_type")


def sql_strength(tops="tops", source="c_1h", name="strong"):
    """CTE `name`: tops with strength in seconds, permanence and timeframe."""
    def side(left):
        cmp = "b.date < a.date" if left else "b.date > a.date"
        return f"""SELECT a.symbol, a.date, a.top_type, {"max" if left else "min"}(b.date) AS t FROM {tops} a
          JOIN {source} b ON a.symbol = b.symbol AND {cmp} AND CASE a.top_type WHEN 'peak' THEN b.high > a.high ELSE b.low < a.low END
          GROUP BY 1, 2, 3"""
    return f"""
{name}_r AS ({side(False)}), {name}_l AS ({side(True)}),
{name}_e AS (SELECT symbol, min(date) AS s, max(date) AS e FROM {source} GROUP BY 1),
{name}_d AS (SELECT t.*, least(epoch(r.t - t.date), epoch(t.date - l.t)) AS beaten, epoch(t.date - e.s) AS from_start, epoch(e.e - t.date) AS to_end
  FROM {tops} t JOIN {name}_e e ON t.symbol = e.symbol
  LEFT JOIN {name}_r r ON t.symbol = r.symbol AND t.date = r.date AND t.top_type = r.top_type
  LEFT JOIN {name}_l l ON t.symbol = l.symbol AND t.date = l.date AND t.top_type = l.top_type),
{name} AS (SELECT *, CAST(least(beaten, from_start, to_end) AS BIGINT) AS strength, beaten < from_start AND beaten < to_end AS permanent_strength,
  CASE WHEN least(beaten, from_start, to_end) >= 2 * 604800 THEN '1W' WHEN least(beaten, from_start, to_end) >= 2 * 86400 THEN '1D'
       WHEN least(beaten, from_start, to_end) >= 2 * 14400 THEN '4h' ELSE '1h' END AS timeframe FROM {name}_d)"""


@query("top_strength", f"""WITH {sql_candles()}, {sql_tops()}, {sql_strength()}
SELECT symbol, date, top_type, strength, permanent_strength FROM strong""")
def top_strength(spark, sf):
    c = staged(candles(spark, sf))
    out = tp.add_strength(staged(tp.find_tops(c)), c, "1h")
    return out.select(*KEY, "top_type", "strength", "permanent_strength")


@query("timeframe_tops", f"""WITH {sql_candles()}, {sql_tops()}, {sql_strength()}
SELECT symbol, timeframe, date, top_type, strength FROM strong
WHERE date > TIMESTAMP '2024-01-02' AND date < TIMESTAMP '2024-01-29'""")
def timeframe_tops(spark, sf):
    out = tp.timeframe_tops(staged(candles(spark, sf)), "1h", ["1h", "4h", "1D", "1W"], "2024-01-02", "2024-01-29")
    return out.select("symbol", "timeframe", "date", "top_type", "strength")


@query("strength_to_timeframe", f"""WITH {sql_candles()}, {sql_tops()}, {sql_strength()}
SELECT symbol, date, top_type, CASE WHEN strength > 604800 THEN '1W' WHEN strength > 86400 THEN '1D' WHEN strength > 14400 THEN '4h'
  ELSE '1h' END AS mapped FROM strong WHERE strength > 3600""")
def strength_to_timeframe(spark, sf):
    c = staged(candles(spark, sf))
    out = tp.add_strength(staged(tp.find_tops(c)), c, "1h")
    mapped = tp.strength_timeframe(F.col("strength"), ["1h", "4h", "1D", "1W"])
    return out.withColumn("mapped", mapped).where("mapped is not null").select(*KEY, "top_type", "mapped")
