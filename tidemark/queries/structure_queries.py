"""Market structure: trends, bases, pivots, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import minutes_of
from tidemark.operators.smoothing import add_atr
from tidemark.plans import bases as bp
from tidemark.plans import pivots as pv
from tidemark.plans import signals as sg
from tidemark.plans import tops as tp
from tidemark.plans import trends as tr
from tidemark.queries import query
from tidemark.queries.join_queries import sql_strength, sql_tops
from tidemark.queries.views import HIGHER, LADDER, candles, r6, s6, sql_atr, sql_candles, sql_stacked, stacked
from tidemark.session import staged

KEY = ["symbol", "timeframe", "date"]
W = "PARTITION BY symbol, timeframe ORDER BY date"
HOUR = 3600
ATR = 5


# --- shared inputs ---------------------------------------------------------------------------------------


def _mt(spark, sf):
    """Stacked candles with ATR, staged."""
    return staged(add_atr(stacked(spark, sf), ATR))


def _tops(mt):
    base = mt.where("timeframe = '1h'").drop("atr")
    return staged(tp.timeframe_tops(base, "1h", LADDER))


def _effective(tops):
    return tp.effective_tops(tops, LADDER)


def _trends(spark, sf, expand=True):
    mt = _mt(spark, sf)
    tops = _effective(_tops(mt))
    valid = mt.where("atr is not null")
    # the trend of a candle is found on all candles, the segments on those with an ATR
    trend = tr.candle_trend(tr.add_neighbour_tops(mt, tops, HOUR))
    marked = staged(trend.where("atr is not null").select(*KEY, "bar", "high", "low", "atr", "bull_bear_side"))
    segments = staged(tr.add_segment_extremes(staged(tr.trend_segments(marked)), valid))
    return mt, tops, staged(tr.add_movements(segments, tops, HOUR, expand=expand))


SQL_TFS = "tfs AS (SELECT * FROM (VALUES ('1h', 0, 60), ('4h', 1, 240), ('1D', 2, 1440), ('1W', 3, 10080)) t(tf, r, minutes))"


def sql_mt_atr() -> str:
    """CTEs up to `mta`: stacked candles with ATR."""
    parts = [sql_stacked()] + [sql_atr(f"a_{tf}", f"c_{tf}", ATR) for tf in LADDER]
    cols = "symbol, timeframe, date, open, high, low, close, volume, bar, atr"
    union = " UNION ALL ".join(f"SELECT {cols} FROM a_{tf}" for tf in LADDER)
    return ",".join(parts) + f",\nmta AS ({union})"


SQL_EFFECTIVE = f"""{SQL_TFS},
eff AS (SELECT s.symbol, l.tf AS timeframe, s.date, s.top_type, s.high, s.low, s.strength,
    CASE s.top_type WHEN 'peak' THEN s.high ELSE s.low END AS value
  FROM strong s JOIN tfs o ON s.timeframe = o.tf JOIN tfs l ON l.r <= o.r),
pk AS (SELECT * FROM eff WHERE top_type = 'peak'), vl AS (SELECT * FROM eff WHERE top_type = 'valley')"""

SQL_BASE = f"{sql_mt_atr()}, {sql_tops()}, {sql_strength()}, {SQL_EFFECTIVE}"


def _asof(alias, table, op):
    on = f"m.symbol = {alias}.symbol AND m.timeframe = {alias}.timeframe AND {alias}.date {op}"
    return f"ASOF LEFT JOIN {table} {alias} ON {on}"


SQL_NEIGHBOURS = f"""
nb AS (SELECT m.*, pp.date AS ppd, pp.value AS ppv, np.date AS npd, np.value AS npv,
    pv.date AS pvd, pv.value AS pvv, nv.date AS nvd, nv.value AS nvv
  FROM mta m {_asof("pp", "pk", "<= m.date - INTERVAL 1 HOUR")} {_asof("np", "pk", ">= m.date + INTERVAL 1 HOUR")}
  {_asof("pv", "vl", "<= m.date - INTERVAL 1 HOUR")} {_asof("nv", "vl", ">= m.date + INTERVAL 1 HOUR")})"""

SQL_TREND = f"""
ct0 AS (SELECT *, CASE WHEN npv > ppv AND nvv > pvv THEN 'BULLISH_TREND' WHEN npv < ppv AND nvv < pvv THEN 'BEARISH_TREND'
    WHEN npv IS NOT NULL AND ppv IS NOT NULL AND nvv IS NOT NULL AND pvv IS NOT NULL THEN 'SIDE_TREND' END AS t FROM nb),
ct AS (SELECT *, t IS NOT NULL AS is_final, coalesce(last_value(t IGNORE NULLS) OVER ({W}),
    first_value(t IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'SIDE_TREND') AS side FROM ct0)"""

SQL_SEGMENTS = f"""
sg0 AS (SELECT symbol, timeframe, date, side, lag(side) OVER ({W}) AS before, max(date) OVER (PARTITION BY symbol, timeframe) AS last_date
  FROM ct WHERE atr IS NOT NULL),
seg AS (SELECT symbol, timeframe, date, side, coalesce(lead(date) OVER ({W}), last_date) AS "end" FROM sg0
  WHERE before IS NULL OR before <> side),
pl0 AS (SELECT m.symbol, m.timeframe, m.date, m.high, m.low, m.atr, s.date AS segment FROM mta m
  ASOF LEFT JOIN seg s ON m.symbol = s.symbol AND m.timeframe = s.timeframe AND s.date <= m.date WHERE m.atr IS NOT NULL),
ex AS (SELECT symbol, timeframe, segment AS date, max(high) AS ih, min(low) AS il, avg(atr) AS atr FROM pl0 GROUP BY 1, 2, 3),
ext AS (SELECT s.*, e.ih, e.il, e.atr,
    (SELECT min(p.date) FROM pl0 p WHERE p.symbol = s.symbol AND p.timeframe = s.timeframe AND p.segment = s.date AND p.high = e.ih) AS high_time,
    (SELECT min(p.date) FROM pl0 p WHERE p.symbol = s.symbol AND p.timeframe = s.timeframe AND p.segment = s.date AND p.low = e.il) AS low_time
  FROM seg s LEFT JOIN ex e ON s.symbol = e.symbol AND s.timeframe = e.timeframe AND s.date = e.date)"""

SQL_MOVEMENT = f"""
mv0 AS (SELECT m.*, av.date AS avd, av.value AS avv, ap.date AS apd, ap.value AS apv,
    bp.date AS bpd, bp.value AS bpv, bv.date AS bvd, bv.value AS bvv
  FROM ext m {_asof("av", "vl", ">= m.date + INTERVAL 1 HOUR")} {_asof("ap", "pk", ">= m.date + INTERVAL 1 HOUR")}
  {_asof("bp", "pk", '<= m."end" - INTERVAL 1 HOUR')} {_asof("bv", "vl", '<= m."end" - INTERVAL 1 HOUR')}),
mv1 AS (SELECT *, side = 'BULLISH_TREND' AS bull, CASE side WHEN 'BULLISH_TREND' THEN avd WHEN 'BEARISH_TREND' THEN apd END AS sd,
    CASE side WHEN 'BULLISH_TREND' THEN avv WHEN 'BEARISH_TREND' THEN apv END AS sv,
    CASE side WHEN 'BULLISH_TREND' THEN bpd WHEN 'BEARISH_TREND' THEN bvd END AS ed,
    CASE side WHEN 'BULLISH_TREND' THEN bpv WHEN 'BEARISH_TREND' THEN bvv END AS ev FROM mv0),
mv AS (SELECT symbol, timeframe, date, side, bull, "end", ih, il, atr,
    CASE WHEN side = 'SIDE_TREND' THEN NULL WHEN sd < "end" THEN sd ELSE date END AS mst,
    CASE WHEN side = 'SIDE_TREND' THEN NULL WHEN sd < "end" THEN sv WHEN bull THEN il ELSE ih END AS msv,
    CASE WHEN side = 'SIDE_TREND' THEN NULL WHEN ed > date THEN ed ELSE "end" END AS met,
    CASE WHEN side = 'SIDE_TREND' THEN NULL WHEN ed > date THEN ev WHEN bull THEN ih ELSE il END AS mev FROM mv1)"""


def _walk_sql(name, forward):
    """Recursive walk over the tops of one kind as long as each is at least as extreme as the one before."""
    far, cur = ("met", "mev") if forward else ("mst", "msv")
    step = "lead" if forward else "lag"
    cmp = ">= m.met + INTERVAL 1 HOUR" if forward else "<= m.mst - INTERVAL 1 HOUR"
    bull_kind, bear_kind = ("pk", "vl") if forward else ("vl", "pk")
    # sign: peaks must not fall, valleys must not rise
    bull_level, bear_level = ("m.ih", "m.il") if forward else ("m.il", "m.ih")
    bull_sign, bear_sign = (1, -1) if forward else (-1, 1)
    return f"""
{name}_n AS (SELECT symbol, timeframe, top_type, date, value, {step}(date) OVER w AS nd, {step}(value) OVER w AS nv FROM eff
  WINDOW w AS (PARTITION BY symbol, timeframe, top_type ORDER BY date)),
{name}_s AS (
  SELECT m.symbol, m.timeframe, m.date, {bull_sign} AS sign, '{'peak' if bull_kind == 'pk' else 'valley'}' AS kind, t.date AS td, t.value AS tv, {bull_level} AS level
  FROM (SELECT * FROM mv WHERE side = 'BULLISH_TREND') m ASOF JOIN {bull_kind} t ON m.symbol = t.symbol AND m.timeframe = t.timeframe AND t.date {cmp}
  UNION ALL
  SELECT m.symbol, m.timeframe, m.date, {bear_sign}, '{'peak' if bear_kind == 'pk' else 'valley'}', t.date, t.value, {bear_level}
  FROM (SELECT * FROM mv WHERE side = 'BEARISH_TREND') m ASOF JOIN {bear_kind} t ON m.symbol = t.symbol AND m.timeframe = t.timeframe AND t.date {cmp}),
{name}_w AS (
  SELECT symbol, timeframe, date, sign, kind, td, tv, 1 AS steps FROM {name}_s WHERE tv * sign >= level * sign
  UNION ALL
  SELECT w.symbol, w.timeframe, w.date, w.sign, w.kind, n.nd, n.nv, w.steps + 1 FROM {name}_w w
  JOIN {name}_n n ON n.symbol = w.symbol AND n.timeframe = w.timeframe AND n.top_type = w.kind AND n.date = w.td
  WHERE n.nd IS NOT NULL AND n.nv * w.sign >= w.tv * w.sign),
{name} AS (SELECT symbol, timeframe, date, arg_max(td, steps) AS td, arg_max(tv, steps) AS tv FROM {name}_w GROUP BY 1, 2, 3)"""


SQL_EXPANDED = f"""{_walk_sql("we", True)}, {_walk_sql("ws", False)},
tn0 AS (SELECT m.symbol, m.timeframe, m.date, m.side, m."end", m.atr,
    coalesce(s.td, m.mst) AS mst, coalesce(s.tv, m.msv) AS msv, coalesce(e.td, m.met) AS met, coalesce(e.tv, m.mev) AS mev,
    CASE WHEN m.bull THEN coalesce(e.tv, m.ih) WHEN m.side = 'BEARISH_TREND' THEN coalesce(s.tv, m.ih) ELSE m.ih END AS ih,
    CASE WHEN m.bull THEN coalesce(s.tv, m.il) WHEN m.side = 'BEARISH_TREND' THEN coalesce(e.tv, m.il) ELSE m.il END AS il
  FROM mv m LEFT JOIN we e ON m.symbol = e.symbol AND m.timeframe = e.timeframe AND m.date = e.date
  LEFT JOIN ws s ON m.symbol = s.symbol AND m.timeframe = s.timeframe AND m.date = s.date),
tn AS (SELECT *, greatest(ih, msv, mev) - least(il, msv, mev) AS movement, epoch("end" - date) / 60 AS duration,
    (greatest(ih, msv, mev) - least(il, msv, mev)) / nullif(epoch("end" - date) / 60 / (SELECT minutes FROM tfs WHERE tf = timeframe), 0) AS rate
  FROM tn0)"""

SQL_TRENDS = f"{SQL_BASE}, {SQL_NEIGHBOURS}, {SQL_TREND}, {SQL_SEGMENTS}, {SQL_MOVEMENT}, {SQL_EXPANDED}"


# --- tops and trends -------------------------------------------------------------------------------------


@query("effective_tops", f"""WITH {SQL_BASE} SELECT symbol, timeframe, date, top_type FROM eff""")
def effective_tops(spark, sf):
    return _effective(_tops(_mt(spark, sf))).select(*KEY, "top_type")


@query("major_timeframe_tops", f"""WITH {SQL_BASE} SELECT symbol, timeframe, date, top_type FROM strong WHERE timeframe IN ('4h', '1D', '1W')""")
def major_timeframe_tops(spark, sf):
    from tidemark.functions.ladder import TF_MINUTES, rank_of

    ranks = list(TF_MINUTES).index("4h")
    return _tops(_mt(spark, sf)).where(rank_of("timeframe") >= ranks).select(*KEY, "top_type")


@query("previous_next_tops", f"""WITH {SQL_BASE}, {SQL_NEIGHBOURS}
SELECT symbol, timeframe, date, ppd AS previous_peak_time, ppv AS previous_peak_value, npd AS next_peak_time,
  npv AS next_peak_value, pvd AS previous_valley_time, pvv AS previous_valley_value, nvd AS next_valley_time,
  nvv AS next_valley_value FROM nb""")
def previous_next_tops(spark, sf):
    mt = _mt(spark, sf)
    out = tr.add_neighbour_tops(mt, _effective(_tops(mt)), HOUR)
    return out.select(
        *KEY, *[f"{s}_{k}_{c}" for s in ("previous", "next") for k in ("peak", "valley") for c in ("time", "value")]
    )


@query("candle_trend", f"""WITH {SQL_BASE}, {SQL_NEIGHBOURS}, {SQL_TREND}
SELECT symbol, timeframe, date, side AS bull_bear_side, is_final FROM ct""")
def candle_trend(spark, sf):
    mt = _mt(spark, sf)
    out = tr.candle_trend(tr.add_neighbour_tops(mt, _effective(_tops(mt)), HOUR))
    return out.select(*KEY, "bull_bear_side", "is_final")


@query("rally_base_drop", f"""WITH {SQL_BASE}, {SQL_NEIGHBOURS}
SELECT symbol, timeframe, date, CASE WHEN nvv > pvv AND ppv > npv THEN 'RALLY' WHEN nvv < pvv AND ppv < npv THEN 'DROP' ELSE 'BASE' END
  AS rally_base_drop FROM nb""")
def rally_base_drop(spark, sf):
    mt = _mt(spark, sf)
    return tr.rally_base_drop(tr.add_neighbour_tops(mt, _effective(_tops(mt)), HOUR)).select(*KEY, "rally_base_drop")


@query("trend_segments", f"""WITH {SQL_BASE}, {SQL_NEIGHBOURS}, {SQL_TREND}, {SQL_SEGMENTS}
SELECT symbol, timeframe, date, side AS bull_bear_side, "end", ih AS internal_high, il AS internal_low, high_time, low_time,
  {s6("atr", "atr")} FROM ext""")
def trend_segments(spark, sf):
    _, _, trends = _trends_plain(spark, sf)
    return trends.select(
        *KEY, "bull_bear_side", "end", "internal_high", "internal_low", "high_time", "low_time", r6("atr").alias("atr")
    )


def _trends_plain(spark, sf):
    mt = _mt(spark, sf)
    tops = _effective(_tops(mt))
    valid = mt.where("atr is not null")
    trend = tr.candle_trend(tr.add_neighbour_tops(mt, tops, HOUR))
    marked = staged(trend.where("atr is not null").select(*KEY, "bar", "bull_bear_side"))
    return mt, tops, tr.add_segment_extremes(staged(tr.trend_segments(marked)), valid)


@query("trend_movements", f"""WITH {SQL_BASE}, {SQL_NEIGHBOURS}, {SQL_TREND}, {SQL_SEGMENTS}, {SQL_MOVEMENT}
SELECT symbol, timeframe, date, mst AS movement_start_time, msv AS movement_start_value, met AS movement_end_time,
  mev AS movement_end_value FROM mv""")
def trend_movements(spark, sf):
    _, _, trends = _trends(spark, sf, expand=False)
    return trends.select(
        *KEY, "movement_start_time", "movement_start_value", "movement_end_time", "movement_end_value"
    )


@query("expanded_trends", f"""WITH RECURSIVE {SQL_TRENDS}
SELECT symbol, timeframe, date, side AS bull_bear_side, "end", mst AS movement_start_time, msv AS movement_start_value,
  met AS movement_end_time, mev AS movement_end_value, ih AS internal_high, il AS internal_low, {s6("movement", "movement")},
  duration AS duration_minutes, {s6("rate", "rate")}, {s6("rate / nullif(atr, 0)", "strength")} FROM tn""")
def expanded_trends(spark, sf):
    _, _, trends = _trends(spark, sf)
    return trends.select(
        *KEY, "bull_bear_side", "end", "movement_start_time", "movement_start_value", "movement_end_time",
        "movement_end_value", "internal_high", "internal_low", r6("movement").alias("movement"), "duration_minutes",
        r6("rate").alias("rate"), r6("strength").alias("strength"),
    )


@query("weak_trends_as_side", f"""WITH RECURSIVE {SQL_TRENDS}
SELECT symbol, timeframe, date, CASE WHEN rate / nullif(atr, 0) < 0.7 THEN 'SIDE_TREND' ELSE side END AS bull_bear_side FROM tn""")
def weak_trends_as_side(spark, sf):
    return tr.ignore_weak(_trends(spark, sf)[2]).select(*KEY, "bull_bear_side")


SQL_PREVIOUS = """
pt0 AS (SELECT symbol, timeframe, met, date, movement, mst, msv,
    row_number() OVER (PARTITION BY symbol, timeframe, met ORDER BY movement DESC, date) AS k FROM tn WHERE met IS NOT NULL),
pt AS (SELECT t.*, p.date AS previous_trend, p.movement AS previous_movement, p.mst AS pmst, p.msv AS pmsv FROM tn t
  LEFT JOIN pt0 p ON p.symbol = t.symbol AND p.timeframe = t.timeframe AND p.met = t.mst AND p.k = 1)"""


@query("previous_trend", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_PREVIOUS}
SELECT symbol, timeframe, date, previous_trend, {s6("previous_movement", "previous_trend_movement")} FROM pt""")
def previous_trend(spark, sf):
    out = tr.add_previous_trend(_trends(spark, sf)[2])
    return out.select(*KEY, "previous_trend", r6("previous_trend_movement").alias("previous_trend_movement"))


@query("biggest_trend_per_end", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_PREVIOUS}
SELECT symbol, timeframe, date, met AS movement_end_time, {s6("movement", "movement")} FROM pt0 WHERE k = 1""")
def biggest_trend_per_end(spark, sf):
    out = tr.biggest_per_end(_trends(spark, sf)[2].where("movement_end_time is not null"))
    return out.select(*KEY, "movement_end_time", r6("movement").alias("movement"))


@query("merged_trends", f"""WITH RECURSIVE {SQL_TRENDS},
i0 AS (SELECT symbol, timeframe, date, mst, met, max(met) OVER (PARTITION BY symbol, timeframe ORDER BY mst, met, date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM tn WHERE mst < met),
i1 AS (SELECT *, last_value(CASE WHEN reach IS NULL OR mst >= reach THEN mst END IGNORE NULLS)
  OVER (PARTITION BY symbol, timeframe ORDER BY mst, met, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i0)
SELECT symbol, timeframe, island AS movement_start_time, max(met) AS movement_end_time, min(date) AS date, count(*) AS merged
FROM i1 GROUP BY symbol, timeframe, island""")
def merged_trends(spark, sf):
    return tr.merge_overlaps(_trends(spark, sf)[2])


SQL_SIGNIFICANT = """
inside AS (SELECT DISTINCT e.symbol, e.timeframe, t.date AS trend, e.date, e.top_type, e.value, e.strength FROM tn t JOIN eff e
  ON e.symbol = t.symbol AND e.timeframe = t.timeframe AND e.date BETWEEN t.date AND t."end"),
sig AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, trend, top_type ORDER BY strength DESC, date) AS n FROM inside)"""


@query("significant_tops", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_SIGNIFICANT}
SELECT symbol, timeframe, trend, date, top_type, n FROM sig WHERE n <= 2""")
def significant_tops(spark, sf):
    _, tops, trends = _trends(spark, sf)
    return tr.significant_tops(trends, tops).select("symbol", "timeframe", "trend", "date", "top_type", "n")


@query("trend_channel_lines", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_SIGNIFICANT},
pts AS (SELECT symbol, timeframe, trend, top_type, n, epoch(date - trend) / 60 AS x, value AS y,
    row_number() OVER (PARTITION BY symbol, timeframe, trend, top_type ORDER BY date) AS k FROM sig WHERE n <= 2),
ln AS (SELECT t.symbol, t.timeframe, t.date, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy FROM tn t
  LEFT JOIN pts a ON a.symbol = t.symbol AND a.timeframe = t.timeframe AND a.trend = t.date AND a.k = 1 AND a.top_type = CASE t.side WHEN 'BULLISH_TREND' THEN 'valley' ELSE 'peak' END
  LEFT JOIN pts b ON b.symbol = t.symbol AND b.timeframe = t.timeframe AND b.trend = t.date AND b.k = 2 AND b.top_type = CASE t.side WHEN 'BULLISH_TREND' THEN 'valley' ELSE 'peak' END
  LEFT JOIN pts c ON c.symbol = t.symbol AND c.timeframe = t.timeframe AND c.trend = t.date AND c.n = 1 AND c.top_type = CASE t.side WHEN 'BULLISH_TREND' THEN 'peak' ELSE 'valley' END
  WHERE t.side <> 'SIDE_TREND')
SELECT symbol, timeframe, date, {s6("(b_y - ay) / nullif(bx - ax, 0)", "trend_slope")},
  {s6("ay - ax * ((b_y - ay) / nullif(bx - ax, 0))", "trend_base")}, {s6("cy - cx * ((b_y - ay) / nullif(bx - ax, 0))", "channel_base")} FROM ln""")
def trend_channel_lines(spark, sf):
    _, tops, trends = _trends(spark, sf)
    out = tr.add_channel_lines(trends, tops)
    return out.select(*KEY, *[r6(c).alias(c) for c in ("trend_slope", "trend_base", "channel_base")])


@query("trend_overlap_violations", f"""WITH RECURSIVE {SQL_TRENDS},
o AS (SELECT symbol, timeframe, mst AS start, met AS "end", max(met) OVER (PARTITION BY symbol, timeframe ORDER BY mst, met, date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tn WHERE mst IS NOT NULL)
SELECT symbol, timeframe, start, "end" FROM o WHERE reach > start""")
def trend_overlap_violations(spark, sf):
    trends = _trends(spark, sf)[2].where("movement_start_time is not null")
    out = tr.overlap_violations(trends, "movement_start_time", "movement_end_time")
    return out.select("symbol", "timeframe", "start", "end")


# --- bases and signals -----------------------------------------------------------------------------------

WH = "PARTITION BY symbol, timeframe ORDER BY bar"


@query("candle_size", f"""WITH {sql_mt_atr()}
SELECT symbol, timeframe, date, {s6("(high - low) / nullif(atr, 0)", "atr_ratio")},
  CASE WHEN (high - low) / nullif(atr, 0) <= 0.8 THEN 'Spinning' WHEN (high - low) / nullif(atr, 0) <= 1.2 THEN 'Standard'
       WHEN (high - low) / nullif(atr, 0) <= 2.5 THEN 'Long' WHEN (high - low) / nullif(atr, 0) > 2.5 THEN 'Spike' END AS size FROM mta""")
def candle_size(spark, sf):
    return bp.add_candle_size(add_atr(stacked(spark, sf), ATR)).select(*KEY, r6("atr_ratio").alias("atr_ratio"), "size")


@query("spinning_runs", f"""WITH {sql_mt_atr()},
s AS (SELECT *, (high - low) / nullif(atr, 0) <= 0.8 AS spin FROM mta WHERE atr IS NOT NULL)
SELECT symbol, timeframe, date FROM (SELECT *, lag(spin) OVER ({WH}) AS before FROM s) WHERE spin AND before""")
def spinning_runs(spark, sf):
    mt = add_atr(stacked(spark, sf), ATR).where("atr is not null")
    return bp.spinning_runs(mt, 2).select(*KEY)


@query("candle_overlaps", f"""WITH {sql_mt_atr()},
p AS (SELECT *, lag(low) OVER ({WH}) AS pl, lag(high) OVER ({WH}) AS ph FROM mta)
SELECT symbol, timeframe, date, {s6("coalesce((least(high, ph) - greatest(low, pl)) / nullif(high - low, 0), 0)", "overlap")},
  greatest(low, pl) AS shared_low, least(high, ph) AS shared_high FROM p""")
def candle_overlaps(spark, sf):
    out = bp.add_overlaps(add_atr(stacked(spark, sf), ATR), 2).withColumn("_s", F.col("shared")[0])
    return out.select(*KEY, r6("_s.overlap").alias("overlap"), F.col("_s.low").alias("shared_low"),
                      F.col("_s.high").alias("shared_high"))


OVERLAP, BAND = 0.3, 0.1

SQL_BASES = f"""
b0 AS (SELECT *, (high - low) / nullif(atr, 0) <= 0.8 AS spin, greatest(low, lag(low) OVER ({WH})) AS lo,
    least(high, lag(high) OVER ({WH})) AS hi FROM mta WHERE atr IS NOT NULL),
b1 AS (SELECT *, coalesce((hi - lo) / nullif(high - low, 0), 0) AS ov FROM b0),
b2 AS (SELECT *, lag(spin) OVER ({WH}) AS spin1, lag(lo) OVER ({WH}) AS lo1, lag(hi) OVER ({WH}) AS hi1, lag(ov) OVER ({WH}) AS ov1 FROM b1),
b3 AS (SELECT *, greatest(lo, lo1) AS il0, least(hi, hi1) AS ih0 FROM b2 WHERE spin AND spin1 AND ov > {OVERLAP} AND ov1 > {OVERLAP}),
bs0 AS (SELECT symbol, timeframe, date, atr, ih0 <= il0 AS zero_trigger_candle,
    CASE WHEN ih0 > il0 THEN il0 WHEN hi - lo <= hi1 - lo1 THEN lo ELSE lo1 END AS internal_low,
    CASE WHEN ih0 > il0 THEN ih0 WHEN hi - lo <= hi1 - lo1 THEN hi ELSE hi1 END AS internal_high,
    date + INTERVAL (t.minutes * 256) MINUTE AS ttl, date + INTERVAL (t.minutes) MINUTE AS since,
    (SELECT tf FROM tfs WHERE r = t.r + 1) AS tf1, (SELECT tf FROM tfs WHERE r = t.r + 2) AS tf2
  FROM b3 JOIN tfs t ON t.tf = timeframe),
va AS (SELECT symbol, timeframe, date, atr FROM mta WHERE atr IS NOT NULL),
h1 AS (SELECT symbol, date, high, low, atr FROM mta WHERE timeframe = '1h' AND atr IS NOT NULL),
bs1 AS (SELECT b.*, x.atr AS a_pattern_atr FROM bs0 b ASOF LEFT JOIN va x ON b.symbol = x.symbol AND b.tf1 = x.timeframe AND x.date <= b.date),
bs2 AS (SELECT b.*, x.atr AS a_trigger_atr FROM bs1 b ASOF LEFT JOIN va x ON b.symbol = x.symbol AND b.tf2 = x.timeframe AND x.date <= b.date),
up AS (SELECT b.symbol, b.timeframe, b.date, min(h.date) AS at FROM bs0 b JOIN h1 h ON h.symbol = b.symbol AND h.date BETWEEN b.since AND b.ttl
  AND h.low < b.internal_low - b.atr * {BAND} GROUP BY 1, 2, 3),
dn AS (SELECT b.symbol, b.timeframe, b.date, min(h.date) AS at FROM bs0 b JOIN h1 h ON h.symbol = b.symbol AND h.date BETWEEN b.since AND b.ttl
  AND h.high > b.internal_high + b.atr * {BAND} GROUP BY 1, 2, 3),
bases AS (SELECT b.*, h.atr AS base_atr, up.at AS upper_at, dn.at AS below_at FROM bs2 b
  LEFT JOIN h1 h ON h.symbol = b.symbol AND h.date = b.date
  LEFT JOIN up ON up.symbol = b.symbol AND up.timeframe = b.timeframe AND up.date = b.date
  LEFT JOIN dn ON dn.symbol = b.symbol AND dn.timeframe = b.timeframe AND dn.date = b.date)"""
SQL_TO_BASES = f"{sql_mt_atr()}, {SQL_TFS}, {SQL_BASES}"


def _bases(mt):
    return bp.base_patterns(mt, LADDER, LADDER, least_overlap=OVERLAP, band_atrs=BAND)


@query("base_patterns", f"""WITH {SQL_TO_BASES}
SELECT symbol, timeframe, date, internal_low, internal_high, zero_trigger_candle, ttl, {s6("atr", "atr")},
  {s6("a_pattern_atr", "a_pattern_atr")}, {s6("a_trigger_atr", "a_trigger_atr")}, upper_at AS upper_band_activated,
  below_at AS below_band_activated FROM bases""")
def base_patterns(spark, sf):
    return _bases(_mt(spark, sf)).select(
        *KEY, "internal_low", "internal_high", "zero_trigger_candle", "ttl", r6("atr").alias("atr"),
        r6("a_pattern_atr").alias("a_pattern_atr"), r6("a_trigger_atr").alias("a_trigger_atr"), "upper_band_activated",
        "below_band_activated",
    )


@query("base_timeframe_atr", f"""WITH {SQL_TO_BASES}
SELECT symbol, timeframe, date, {s6("base_atr", "base_timeframe_atr")}, internal_high - internal_low < base_atr * 3 AS ignore_backtesting FROM bases""")
def base_timeframe_atr(spark, sf):
    return _bases(_mt(spark, sf)).select(*KEY, r6("base_timeframe_atr").alias("base_timeframe_atr"), "ignore_backtesting")


@query("first_passed_candle", f"""WITH {SQL_TO_BASES} SELECT up.symbol, up.timeframe, up.date, up.at AS passed FROM up""")
def first_passed_candle(spark, sf):
    mt = _mt(spark, sf)
    valid = mt.where("atr is not null")
    found = bp.base_candles(valid, least_overlap=OVERLAP)
    found = found.withColumns(
        {"ttl": plus_seconds("date", minutes_of("timeframe") * 60 * bp.TTL_BARS),
         "level": F.col("internal_low") - F.col("atr") * BAND}
    ).select(*KEY, "ttl", "level")
    base = valid.where("timeframe = '1h'").drop("timeframe")
    return bp.first_passed(staged(found), base, "level", "low", "lt", "1h", "passed").where("passed is not null").select(*KEY, "passed")


SQL_SIGNALS = f"""
sg AS (SELECT symbol, upper_at AS date, date AS ref_date, timeframe AS ref_timeframe, 'buy' AS side, ttl AS "end",
    internal_high + atr * 0.05 AS limit_price, internal_low AS stop_loss, internal_high + (internal_high - internal_low) * 5 AS take_profit,
    internal_high AS trigger_price FROM bases WHERE upper_at > date AND upper_at < ttl
  UNION ALL SELECT symbol, below_at, date, timeframe, 'sell', ttl, internal_low - atr * 0.05, internal_high,
    internal_low - (internal_high - internal_low) * 5, internal_low FROM bases WHERE below_at > date AND below_at < ttl),
signals AS (SELECT * FROM sg WHERE abs(take_profit - limit_price) >= 6 * 0.001 * limit_price * 3)"""


@query("signals", f"""WITH {SQL_TO_BASES}, {SQL_SIGNALS}
SELECT symbol, date, ref_date, ref_timeframe, side, "end", {s6("limit_price", "limit_price")}, stop_loss,
  {s6("take_profit", "take_profit")}, trigger_price FROM signals""")
def signals(spark, sf):
    out = sg.extract_signals(_bases(_mt(spark, sf)))
    return out.select(
        "symbol", "date", "ref_date", "ref_timeframe", "side", "end", r6("limit_price").alias("limit_price"),
        "stop_loss", r6("take_profit").alias("take_profit"), "trigger_price",
    )


@query("active_signals", f"""WITH {SQL_TO_BASES}, {SQL_SIGNALS}
SELECT h.symbol, h.date, count(*) AS active, count(*) FILTER (WHERE side = 'buy') AS buys FROM h1 h JOIN signals s
  ON s.symbol = h.symbol AND s.date <= h.date AND h.date < s."end" GROUP BY 1, 2""")
def active_signals(spark, sf):
    mt = _mt(spark, sf)
    found = staged(sg.extract_signals(_bases(mt)))
    hours = mt.where("timeframe = '1h' and atr is not null").select("symbol", "date")
    alive = sg.active_signals(hours, found, ["side"], 10 * 86_400)
    return alive.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("active"), F.count_if(F.col("side") == "buy").alias("buys")
    )


@query("signal_sizes", f"""WITH {SQL_TO_BASES}, {SQL_SIGNALS}
SELECT symbol, ref_date, ref_timeframe, side, CASE WHEN trigger_price IS NOT NULL AND limit_price IS NOT NULL THEN 'StopLimit' END AS execution_type,
  round(10 / nullif(abs(stop_loss - limit_price), 0), 5) + 0.0 AS size, round(10 / nullif(abs(stop_loss - limit_price), 0) * abs(stop_loss - limit_price), 5) + 0.0 AS risked_money FROM signals""")
def signal_sizes(spark, sf):
    out = sg.add_risk_size(sg.extract_signals(_bases(_mt(spark, sf)))).withColumn("execution_type", sg.execution_type())
    return out.select(
        "symbol", "ref_date", "ref_timeframe", "side", "execution_type", (F.round("size", 5) + F.lit(0.0)).alias("size"),
        (F.round("risked_money", 5) + F.lit(0.0)).alias("risked_money"),
    )


@query("movement_overlap", f"""WITH {sql_candles()},
p AS (SELECT *, lag(high) OVER (PARTITION BY symbol ORDER BY date) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY date) AS pl FROM c_1h)
SELECT symbol, date, {s6("greatest(0.0, least(greatest(high, ph), 60.0) - greatest(least(low, pl), 20.0))", "movement_overlap")} FROM p""")
def movement_overlap(spark, sf):
    out = sg.add_movement_overlap(candles(spark, sf), 20.0, 60.0)
    return out.select("symbol", "date", r6("movement_overlap").alias("movement_overlap"))


# --- pivots ----------------------------------------------------------------------------------------------


def _margin_sql(name, source):
    """CTE `name`: level, margins and ttl for the pivots of `source`."""
    return f"""
{name} AS (SELECT m.*, CASE m.top_type WHEN 'peak' THEN m.high ELSE m.low END AS level, m.top_type = 'peak' AS is_resistance,
    CASE m.top_type WHEN 'peak' THEN greatest(c.open, c.close) ELSE least(c.open, c.close) END AS internal_margin,
    CASE m.top_type WHEN 'peak' THEN m.high + c.atr ELSE m.low - c.atr END AS external_margin,
    m.date + INTERVAL ((SELECT minutes FROM tfs WHERE tf = m.timeframe) * 512) MINUTE AS ttl
  FROM {source} m ASOF LEFT JOIN vac c ON m.symbol = c.symbol AND m.timeframe = c.timeframe AND c.date <= m.date)"""


SQL_VAC = "vac AS (SELECT symbol, timeframe, date, open, close, atr FROM mta WHERE atr IS NOT NULL)"
SQL_TREND_PIVOTS = f"""{SQL_VAC}, {SQL_PREVIOUS},
tp0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, met ORDER BY movement DESC, date) AS k FROM pt
  WHERE movement > atr AND previous_movement > 3 * atr AND met IS NOT NULL),
tp1 AS (SELECT p.symbol, p.timeframe, p.mst AS date, p.pmst AS movement_start_time, p.pmsv AS movement_start_value,
    p.met AS return_end_time, p.mev AS return_end_value, e.top_type, e.high, e.low
  FROM tp0 p JOIN eff e ON e.symbol = p.symbol AND e.timeframe = p.timeframe AND e.date = p.mst WHERE p.k = 1),
{_margin_sql("tpv", "tp1")}"""


def _valid(mt):
    return mt.where("atr is not null")


@query("trend_pivots", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_TREND_PIVOTS}
SELECT symbol, timeframe, date, top_type, level, is_resistance, internal_margin, {s6("external_margin", "external_margin")}, ttl,
  movement_start_time, return_end_time FROM tpv""")
def trend_pivots(spark, sf):
    mt, tops, trends = _trends(spark, sf)
    out = pv.trend_pivots(trends, tops, _valid(mt))
    return out.select(
        *KEY, "top_type", "level", "is_resistance", "internal_margin", r6("external_margin").alias("external_margin"),
        "ttl", "movement_start_time", "return_end_time",
    )


SQL_MAJOR_PIVOTS = f"""
mp0 AS (SELECT s.symbol, l.tf AS timeframe, s.date, s.top_type, s.high, s.low FROM strong s JOIN tfs o ON o.tf = s.timeframe
  JOIN tfs l ON l.r = o.r - 2 JOIN (SELECT symbol, min(date) AS d FROM mta GROUP BY 1) f ON f.symbol = s.symbol
  WHERE s.date >= f.d + INTERVAL (o.minutes) MINUTE),
{_margin_sql("mpv", "mp0")}"""


@query("major_top_pivots", f"""WITH {SQL_BASE}, {SQL_VAC}, {SQL_MAJOR_PIVOTS}
SELECT symbol, timeframe, date, top_type, level, internal_margin, {s6("external_margin", "external_margin")}, ttl FROM mpv""")
def major_top_pivots(spark, sf):
    mt = _mt(spark, sf)
    out = pv.major_top_pivots(_tops(mt), _valid(mt), LADDER)
    return out.select(
        *KEY, "top_type", "level", "internal_margin", r6("external_margin").alias("external_margin"), "ttl"
    )


@query("pivot_margins", f"""WITH {SQL_BASE}, {SQL_VAC}, {_margin_sql("pm", "eff")}
SELECT symbol, timeframe, date, top_type, level, internal_margin, {s6("external_margin", "external_margin")} FROM pm""")
def pivot_margins(spark, sf):
    mt = _mt(spark, sf)
    out = pv.add_level_and_margins(_effective(_tops(mt)), _valid(mt))
    return out.select(*KEY, "top_type", "level", "internal_margin", r6("external_margin").alias("external_margin"))


def _cross_sql(name, source, extra, target, cond, left):
    cmp, pick = ("<", "max") if left else (">", "min")
    return f"""
{name} AS (SELECT a.symbol, a.timeframe, a.date, a.top_type, {pick}(b.date) AS t FROM {source} a JOIN {target} b
  ON b.symbol = a.symbol AND b.date {cmp} a.date AND {cond} {extra} GROUP BY 1, 2, 3, 4)"""


BEFORE, AFTER = 0.9, 0.5
PK = "x.symbol = a.symbol AND x.timeframe = a.timeframe AND x.date = a.date AND x.top_type = a.top_type"
SQL_ATR_PIVOTS = f"""{SQL_VAC},
ap0 AS (SELECT m.symbol, m.timeframe, m.date, m.top_type, m.high, m.low, m.value, c.atr FROM (SELECT * FROM eff WHERE timeframe IN ('4h', '1D')) m
  ASOF LEFT JOIN vac c ON m.symbol = c.symbol AND m.timeframe = c.timeframe AND c.date <= m.date),
ch AS (SELECT symbol, date, high, low FROM mta WHERE timeframe = '1h'),
{_cross_sql("apl", "ap0", "", "ch", f"CASE a.top_type WHEN 'peak' THEN b.low < a.high - {BEFORE} * a.atr ELSE b.high > a.low + {BEFORE} * a.atr END", True)},
{_cross_sql("apr", "ap0", "", "ch", f"CASE a.top_type WHEN 'peak' THEN b.low < a.high - {AFTER} * a.atr ELSE b.high > a.low + {AFTER} * a.atr END", False)},
ap1 AS (SELECT a.*, x.t AS mst, y.t AS ret FROM ap0 a JOIN apl x ON {PK} JOIN apr y ON {PK.replace("x.", "y.")}),
{_cross_sql("aml", "ap1", "AND b.top_type = a.top_type", "strong", "CASE a.top_type WHEN 'peak' THEN b.high > a.high ELSE b.low < a.low END", True)},
{_cross_sql("amr", "ap1", "AND b.top_type = a.top_type", "strong", "CASE a.top_type WHEN 'peak' THEN b.high > a.high ELSE b.low < a.low END", False)},
ap2 AS (SELECT a.*, x.t AS ml, y.t AS mr FROM ap1 a LEFT JOIN aml x ON {PK} LEFT JOIN amr y ON {PK.replace("x.", "y.")}),
ap AS (SELECT *, row_number() OVER (PARTITION BY symbol, date, top_type ORDER BY CASE timeframe WHEN '1D' THEN 0 ELSE 1 END) = 1 AS major_timeframe
  FROM ap2 WHERE (ml IS NULL OR ml <= mst) AND (mr IS NULL OR mr >= ret)),
ap_v AS (SELECT a.*, CASE a.top_type WHEN 'peak' THEN x.low ELSE x.high END AS msv, CASE a.top_type WHEN 'peak' THEN y.low ELSE y.high END AS rev
  FROM ap a JOIN ch x ON x.symbol = a.symbol AND x.date = a.mst JOIN ch y ON y.symbol = a.symbol AND y.date = a.ret)"""


def _atr_pivots(mt, tops, effective):
    return pv.atr_movement_pivots(tops, effective, mt, "1h", ["4h", "1D"], BEFORE, AFTER)


@query("atr_movement_pivots", f"""WITH {SQL_BASE}, {SQL_ATR_PIVOTS}
SELECT symbol, timeframe, date, top_type, mst AS movement_start_time, msv AS movement_start_value, ret AS return_end_time,
  rev AS return_end_value, ml AS left_more_significant_top, mr AS right_more_significant_top, major_timeframe FROM ap_v""")
def atr_movement_pivots(spark, sf):
    mt = _mt(spark, sf)
    tops = _tops(mt)
    out = _atr_pivots(mt, tops, _effective(tops))
    return out.select(
        *KEY, "top_type", "movement_start_time", "movement_start_value", "return_end_time", "return_end_value",
        "left_more_significant_top", "right_more_significant_top", "major_timeframe",
    )


@query("major_timeframe_flag", f"""WITH {SQL_BASE}
SELECT symbol, timeframe, date, top_type, row_number() OVER (PARTITION BY symbol, date, top_type ORDER BY
  CASE timeframe WHEN '1W' THEN 0 WHEN '1D' THEN 1 WHEN '4h' THEN 2 ELSE 3 END) = 1 AS major_timeframe FROM eff""")
def major_timeframe_flag(spark, sf):
    return pv.mark_major(_effective(_tops(_mt(spark, sf)))).select(*KEY, "top_type", "major_timeframe")


@query("more_significant_tops", f"""WITH {SQL_BASE},
{_cross_sql("l", "strong", "AND b.top_type = a.top_type", "strong", "CASE a.top_type WHEN 'peak' THEN b.high > a.high ELSE b.low < a.low END", True)},
{_cross_sql("r", "strong", "AND b.top_type = a.top_type", "strong", "CASE a.top_type WHEN 'peak' THEN b.high > a.high ELSE b.low < a.low END", False)}
SELECT a.symbol, a.timeframe, a.date, a.top_type, x.t AS left_more_significant_top, y.t AS right_more_significant_top FROM strong a
LEFT JOIN l x ON {PK} LEFT JOIN r y ON {PK.replace("x.", "y.")}""")
def more_significant_tops(spark, sf):
    tops = _tops(_mt(spark, sf))
    out = pv.add_more_significant_tops(tops, tops, "1h")
    return out.select(*KEY, "top_type", "left_more_significant_top", "right_more_significant_top")


# real starts, price ranges and their bases, on the pivots of the ATR movement
SQL_REAL = f"""
{_margin_sql("rp", "ap_v")},
rt AS (SELECT *, lag(value) OVER (PARTITION BY symbol, timeframe, top_type ORDER BY date) AS pv FROM eff),
rf AS (SELECT * FROM rt WHERE CASE top_type WHEN 'peak' THEN value > pv ELSE value < pv END),
r1 AS (SELECT *, CASE WHEN is_resistance THEN 'valley' ELSE 'peak' END AS other FROM rp),
r2 AS (SELECT a.*, f.date AS td, f.value AS tv FROM r1 a ASOF LEFT JOIN rf f ON f.symbol = a.symbol AND f.timeframe = a.timeframe
  AND f.top_type = a.other AND f.date <= a.movement_start_time),
r3 AS (SELECT symbol, timeframe, top_type, min(date) AS fd, arg_min(value, date) AS fv FROM eff GROUP BY 1, 2, 3),
rs AS (SELECT a.*, coalesce(a.td, CASE WHEN f.fd <= a.movement_start_time THEN f.fd END, a.movement_start_time) AS real_start_time,
    coalesce(a.tv, CASE WHEN f.fd <= a.movement_start_time THEN f.fv END, a.movement_start_value) AS real_start_value, a.td IS NOT NULL AS real_start_permanent
  FROM r2 a LEFT JOIN r3 f ON f.symbol = a.symbol AND f.timeframe = a.timeframe AND f.top_type = a.other)"""
SQL_TO_REAL = f"{SQL_BASE}, {SQL_ATR_PIVOTS.replace('mst AS mst', 'mst')}, {SQL_REAL}".replace(
    "ap_v AS (SELECT a.*,", "ap_v AS (SELECT a.symbol, a.timeframe, a.date, a.top_type, a.high, a.low, a.mst AS movement_start_time, a.ret AS return_end_time,"
).replace("AS msv, CASE", "AS movement_start_value, CASE")


def _real(mt, tops):
    effective = _effective(tops)
    found = staged(_atr_pivots(mt, tops, effective))
    found = found.select(
        *KEY, "top_type", "high", "low", "movement_start_time", "movement_start_value", "return_end_time"
    )
    return staged(pv.add_real_start(staged(pv.add_level_and_margins(found, _valid(mt))), effective))


@query("pivot_real_start", f"""WITH {SQL_TO_REAL}
SELECT symbol, timeframe, date, top_type, real_start_time, real_start_value, real_start_permanent,
  {s6("level - real_start_value", "real_movement")} FROM rs""")
def pivot_real_start(spark, sf):
    mt = _mt(spark, sf)
    out = _real(mt, _tops(mt))
    return out.select(
        *KEY, "top_type", "real_start_time", "real_start_value", "real_start_permanent",
        r6("real_movement").alias("real_movement"),
    )


SQL_RANGE = """
pr AS (SELECT *, level - (level - real_start_value) * 0.38 AS rsv, least(level, level - (level - real_start_value) * 0.38) AS rlo,
    greatest(level, level - (level - real_start_value) * 0.38) AS rhi FROM rs)"""


@query("bases_by_price", f"""WITH {SQL_TO_REAL}, {SQL_RANGE}, {SQL_BASES.replace("h1 AS", "h1 AS")},
m AS (SELECT p.symbol, p.timeframe, p.date, p.top_type, b.timeframe AS base_timeframe, t.r, count(*) AS n, min(b.date) AS first_base, sum(b.internal_low) AS lows
  FROM pr p JOIN bases b ON b.symbol = p.symbol AND b.date <= p.date AND b.ttl >= p.date AND b.internal_low < p.rhi AND b.internal_low > p.rlo
  JOIN tfs t ON t.tf = b.timeframe JOIN tfs o ON o.tf = p.timeframe AND t.r <= o.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, date, top_type ORDER BY r DESC) AS k FROM m)
SELECT symbol, timeframe, date, top_type, base_timeframe, n AS bases, first_base, {s6("lows", "lows")} FROM k WHERE k = 1""")
def bases_by_price(spark, sf):
    mt = _mt(spark, sf)
    pivots = pv.add_price_range(_real(mt, _tops(mt)))
    out = pv.bases_in_price_range(pivots, staged(_bases(mt)), LADDER).where("bases is not null")
    return out.select(
        *KEY, "top_type", "base_timeframe", F.size("bases").alias("n_bases"), F.col("bases")[0]["base_date"].alias("first_base"),
        r6(F.aggregate("bases", F.lit(0.0), lambda a, b: a + b["internal_low"])).alias("lows"),
    ).withColumnRenamed("n_bases", "bases")


SQL_RANGE_START = f"""
rst AS (SELECT a.symbol, a.timeframe, a.date, a.top_type, max(b.date) AS t FROM pr a JOIN ch b ON b.symbol = a.symbol AND b.date < a.date
  AND CASE a.top_type WHEN 'peak' THEN b.low < a.rsv ELSE b.high > a.rsv END GROUP BY 1, 2, 3, 4)"""


@query("price_range_start", f"""WITH {SQL_TO_REAL}, {SQL_RANGE}, {SQL_RANGE_START}
SELECT a.symbol, a.timeframe, a.date, a.top_type, x.t AS range_start_time FROM pr a LEFT JOIN rst x ON {PK}""")
def price_range_start(spark, sf):
    mt = _mt(spark, sf)
    pivots = staged(pv.add_price_range(_real(mt, _tops(mt))))
    out = pv.add_range_start_time(pivots, mt.where("timeframe = '1h'"), "1h")
    return out.select(*KEY, "top_type", "range_start_time")


@query("bases_by_time", f"""WITH {SQL_TO_REAL}, {SQL_RANGE}, {SQL_RANGE_START}, {SQL_BASES},
m AS (SELECT p.symbol, p.timeframe, p.date, p.top_type, b.timeframe AS base_timeframe, t.r, count(*) AS n, min(b.date) AS first_base
  FROM rst p JOIN bases b ON b.symbol = p.symbol AND b.date < p.date AND b.date > p.t
  JOIN tfs t ON t.tf = b.timeframe JOIN tfs o ON o.tf = p.timeframe AND t.r <= o.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, date, top_type ORDER BY r DESC) AS k FROM m)
SELECT symbol, timeframe, date, top_type, base_timeframe, n AS bases, first_base FROM k WHERE k = 1""")
def bases_by_time(spark, sf):
    mt = _mt(spark, sf)
    pivots = staged(pv.add_price_range(_real(mt, _tops(mt))))
    pivots = staged(pv.add_range_start_time(pivots, mt.where("timeframe = '1h'"), "1h"))
    out = pv.bases_in_time_range(pivots, staged(_bases(mt)), LADDER).where("bases is not null")
    return out.select(
        *KEY, "top_type", "base_timeframe", F.size("bases").alias("n_bases"), F.col("bases")[0]["base_date"].alias("first_base")
    ).withColumnRenamed("n_bases", "bases")


SQL_CLASSIC = f"""{SQL_TREND_PIVOTS}, {SQL_MAJOR_PIVOTS},
cl AS (SELECT symbol, timeframe, date, top_type, level, internal_margin, external_margin FROM tpv
  UNION ALL SELECT symbol, timeframe, date, top_type, level, internal_margin, external_margin FROM mpv)"""


def _classic(spark, sf):
    mt, effective, trends = _trends(spark, sf)
    own = _tops(mt)
    columns = [*KEY, "top_type", "level", "internal_margin", "external_margin"]
    first = pv.trend_pivots(trends, effective, _valid(mt)).select(columns)
    return staged(first.unionByName(pv.major_top_pivots(own, _valid(mt), LADDER).select(columns)))


@query("classic_pivots", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_CLASSIC} SELECT symbol, timeframe, date, top_type, level FROM cl""")
def classic_pivots(spark, sf):
    return _classic(spark, sf).select(*KEY, "top_type", "level")


@query("master_pivot", f"""WITH RECURSIVE {SQL_TRENDS}, {SQL_CLASSIC},
c AS (SELECT *, row_number() OVER () AS id FROM cl),
x AS (SELECT a.id, b.timeframe AS mt, b.date AS md, row_number() OVER (PARTITION BY a.id ORDER BY t.r DESC, b.date) AS k FROM c a JOIN c b
  ON b.symbol = a.symbol AND least(b.internal_margin, b.external_margin) < a.level AND a.level < greatest(b.internal_margin, b.external_margin)
  JOIN tfs t ON t.tf = b.timeframe)
SELECT c.symbol, c.timeframe, c.date, c.top_type, x.mt AS master_pivot_timeframe, x.md AS master_pivot_date FROM c LEFT JOIN x ON x.id = c.id AND x.k = 1""")
def master_pivot(spark, sf):
    out = pv.add_master_pivot(_classic(spark, sf))
    return out.select(*KEY, "top_type", "master_pivot_timeframe", "master_pivot_date")


# --- life of the pivots of every timeframe -------------------------------------------------------------------------------

SQL_MINUTES = "CASE a.timeframe WHEN '1h' THEN 60 WHEN '4h' THEN 240 WHEN '1D' THEN 1440 ELSE 10080 END"
SQL_FLIP = f"""
h4 AS (SELECT symbol, timeframe, date, high, low FROM mta),
fl AS (
  SELECT symbol, timeframe, date AS original_start, top_type, date, is_resistance, internal_margin, external_margin, ttl, return_end_time, 0 AS flips,
    (SELECT min(b.date) FROM h4 b WHERE b.symbol = a.symbol AND b.timeframe = a.timeframe AND b.date > a.date
      AND CASE WHEN a.is_resistance THEN b.low > a.external_margin ELSE b.high < a.external_margin END) AS passing_time
  FROM rp a
  UNION ALL
  SELECT f.symbol, f.timeframe, f.original_start, f.top_type, f.passing_time, NOT f.is_resistance, f.external_margin, f.internal_margin, f.ttl, f.passing_time, f.flips + 1,
    (SELECT min(b.date) FROM h4 b WHERE b.symbol = f.symbol AND b.timeframe = f.timeframe AND b.date > f.passing_time
      AND CASE WHEN NOT f.is_resistance THEN b.low > f.internal_margin ELSE b.high < f.internal_margin END)
  FROM fl f WHERE f.passing_time < f.ttl)"""


def _hit_sql(name, source, out, since, touch, limited):
    op = (">=", "<=") if touch else ("<", ">")
    limit = f"CASE WHEN t > passing_time THEN NULL ELSE t END" if limited else "t"
    return f"""
{name} AS (SELECT * EXCLUDE (t), {limit} AS {out} FROM (SELECT a.*, (SELECT min(b.date) FROM h4 b WHERE b.symbol = a.symbol AND b.timeframe = a.timeframe
    AND b.date > {since} + to_minutes({SQL_MINUTES}) AND CASE WHEN a.is_resistance THEN b.high {op[0]} a.internal_margin ELSE b.low {op[1]} a.internal_margin END) AS t
  FROM {source} a))"""


SQL_HITS = f"""{_hit_sql("k0", "fl", "e0", "greatest(a.return_end_time, a.date)", False, False)},
{_hit_sql("k1", "k0", "s1", "a.e0", True, True)}, {_hit_sql("k2", "k1", "e1", "a.s1", False, True)},
{_hit_sql("k3", "k2", "s2", "a.e1", True, True)}, {_hit_sql("k4", "k3", "e2", "a.s2", False, True)},
life AS (SELECT k4.*, CASE WHEN e2 IS NOT NULL THEN 3 WHEN e1 IS NOT NULL THEN 2 ELSE 0 END AS hit,
    coalesce(least(coalesce(e2, CASE WHEN passing_time < ttl THEN passing_time END), CASE WHEN coalesce(e2, CASE WHEN passing_time < ttl THEN passing_time END) IS NOT NULL THEN ttl END),
      CASE WHEN ttl < l.d THEN ttl END) AS deactivated_at
  FROM k4 JOIN (SELECT symbol, timeframe, max(date) AS d FROM h4 GROUP BY 1, 2) l ON l.symbol = k4.symbol AND l.timeframe = k4.timeframe)"""


def _margined_pivots(spark, sf):
    mt = _mt(spark, sf)
    tops = _tops(mt)
    found = staged(_atr_pivots(mt, tops, _effective(tops)))
    found = found.select(*KEY, "top_type", "high", "low", "return_end_time")
    pivots = staged(pv.add_level_and_margins(found, _valid(mt)).drop("high", "low"))
    return pivots, mt


@query("pivot_passing_flips", f"""WITH RECURSIVE {SQL_TO_REAL}, {SQL_FLIP}
SELECT symbol, timeframe, original_start, top_type, date, is_resistance, flips, passing_time FROM fl""")
def pivot_passing_flips(spark, sf):
    pivots, mt = _margined_pivots(spark, sf)
    out = pv.flip_on_passing(pivots, mt, LADDER[0])
    return out.select("symbol", "timeframe", "original_start", "top_type", "date", "is_resistance", "flips", "passing_time")


@query("pivot_life", f"""WITH RECURSIVE {SQL_TO_REAL}, {SQL_FLIP}, {SQL_HITS}
SELECT symbol, timeframe, original_start, top_type, date, flips, e0 AS hit_end_0, s1 AS hit_start_1, e1 AS hit_end_1, s2 AS hit_start_2, e2 AS hit_end_2, hit, deactivated_at FROM life""")
def pivot_life(spark, sf):
    pivots, mt = _margined_pivots(spark, sf)
    out = pv.pivot_life(pivots, mt, LADDER[0])
    return out.select(
        "symbol", "timeframe", "original_start", "top_type", "date", "flips", "hit_end_0", "hit_start_1", "hit_end_1", "hit_start_2",
        "hit_end_2", "hit", "deactivated_at",
    )
