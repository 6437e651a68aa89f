"""Samples: extremum features and the whole training set."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import dataset as ds
from tidemark.plans import features as ft
from tidemark.plans import tops as tp
from tidemark.queries import query
from tidemark.queries.feature_queries import _labels_sql
from tidemark.queries.join_queries import sql_extremum
from tidemark.queries.views import candles, r6, s6, sql_atr, sql_candles, sql_stacked, stacked
from tidemark.session import staged

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY bar"
# a layout the thirty days of the given ticks can fill
LAYOUT = ds.Layout(
    windows={"1h": 5, "4h": 4, "1D": 3}, lengths={"1D": 4}, default_length=6, horizon=12, floor_tf="4h",
    floor_length=14, gate=1.5,
)


@query("extremum_weight", f"""WITH {sql_candles()}, {sql_extremum()},
j AS (SELECT a.symbol, a.date AS anchor, e.date, epoch(a.date - e.date) / 60 AS age, e.size, e.sign FROM c_1h a
  JOIN ext e ON e.symbol = a.symbol AND e.bar BETWEEN a.bar - 5 AND a.bar),
o AS (SELECT *, least(size, coalesce(list_max(list_filter([5, 15, 60, 240, 1440, 10080, 43200, 172800, 525600], lambda r: r <= age)), 0)) AS seen FROM j)
SELECT symbol, anchor, date, CAST(seen AS DOUBLE) AS observed, {s6("CASE WHEN seen = 0 THEN 0.0 ELSE sign * ln(1 + seen / 60.0) * least(1.0, age / seen) END", "weight")} FROM o""")
def extremum_weight(spark, sf):
    ext = staged(tp.add_true_extremum(staged(candles(spark, sf)), "1h"))
    anchors = ext.select("symbol", F.col("date").alias("anchor"), F.explode(F.sequence(F.col("bar") - 5, F.col("bar"))).alias("bar"))
    rows = anchors.join(ext, ["symbol", "bar"])
    size, sign = F.col("true_extremum_tf_minutes"), F.col("extremum_sign")
    return rows.select(
        "symbol", "anchor", "date", ft.observed_extremum(size, "anchor", "date").alias("observed"),
        r6(ft.extremum_weight(sign, size, "anchor", "date", 60.0)).alias("weight"),
    )


def _branch_sql(tf: str, length: int) -> str:
    """CTE `br_<tf>`: candles with ATR, static ratios and true extremum of one branch."""
    return f"""{sql_atr(f"at_{tf}", f"c_{tf}", length)}, {sql_extremum(f"at_{tf}", f"ex_{tf}")},
br_{tf} AS (SELECT symbol, date, bar, high, low, close, atr, size, sign, (high - close) / nullif(atr, 0) AS rel_high_close,
    (close - low) / nullif(atr, 0) AS rel_close_low, (open - prev) / nullif(atr, 0) AS open_gap, (high - low) / nullif(atr, 0) AS rel_candle_height,
    CASE WHEN count(*) OVER f = {length} THEN ln((volume + 2.220446049250313e-16) / (avg(volume) OVER f + 2.220446049250313e-16)) END AS log_volume_sma_ratio
  FROM ex_{tf} WINDOW f AS ({W} ROWS {length - 1} PRECEDING))"""


MIN = {"1h": 60, "4h": 240, "1D": 1440, "1W": 10080, "1M": 43200, "4M": 172800}
PLUS = {"1h": ("1D", "1W"), "4h": ("1W", "1M"), "1D": ("1M", "4M")}


def _rows_sql(tf: str) -> str:
    """CTE `rw_<tf>`: window rows of every anchor on one branch with all features."""
    n = LAYOUT.windows[tf]
    off = MIN[tf] - 60
    parts, joins, cols = [], [], []
    for i, target in zip((2, 3), PLUS[tf], strict=True):
        source = LAYOUT.source(target)
        for kind, sign, price in (("peak", 1, "high"), ("valley", -1, "low")):
            name = f"q_{tf}_{i}_{kind}"
            parts.append(f"""
{name} AS (SELECT w.symbol, w.anchor, w.date, arg_min(w.close - e.{price}, abs(w.close - e.{price}) * 1e9 + epoch(e.date) / 1e9) AS diff,
    max(e.date) AS last FROM w_{tf} w JOIN br_{source} e ON e.symbol = w.symbol AND e.sign = {sign} AND e.size >= {MIN[target]}
    AND e.date < w.date AND e.date <= w.anchor - INTERVAL {MIN[target]} MINUTE GROUP BY 1, 2, 3)""")
            joins.append(f"LEFT JOIN {name} ON {name}.symbol = w.symbol AND {name}.anchor = w.anchor AND {name}.date = w.date")
            cols.append(f"coalesce({name}.diff, 0) / nullif(a{i}.atr, 0) AS price_normal_distance_plus{i}tf_{kind}")
            cols.append(f"ln(1 + coalesce(greatest(epoch(w.date - {name}.last) / 60, 0), 0) / {MIN[target]}.0) AS time_distance_plus{i}tf_{kind}")
        joins.append(f"ASOF LEFT JOIN br_{source} a{i} ON a{i}.symbol = w.symbol AND a{i}.date <= w.date - INTERVAL {MIN[source]} MINUTE")
    # as-of joins first: they take the left rows as they are
    joins.sort(key=lambda j: not j.startswith("ASOF"))
    return f"""
w_{tf} AS (SELECT l.symbol, l.date AS anchor, b.date, b.bar - z.bar + {n - 1} AS position, b.close, b.atr, b.size, b.sign, b.rel_high_close,
    b.rel_close_low, b.open_gap, b.rel_candle_height, b.log_volume_sma_ratio, c.close AS a_close, epoch(l.date - b.date) / 60 AS age
  FROM lab l JOIN c_1h c ON c.symbol = l.symbol AND c.date = l.date
  JOIN br_{tf} z ON z.symbol = l.symbol AND z.date = time_bucket(INTERVAL {MIN[tf]} MINUTE, l.date - INTERVAL {off} MINUTE)
  JOIN br_{tf} b ON b.symbol = l.symbol AND b.bar BETWEEN z.bar - {n - 1} AND z.bar),
{",".join(parts)},
s_{tf} AS (SELECT *, least(size, coalesce(list_max(list_filter([5, 15, 60, 240, 1440, 10080, 43200, 172800, 525600], lambda r: r <= age)), 0)) AS seen FROM w_{tf}),
rw_{tf} AS (SELECT w.symbol, w.anchor, '{tf}' AS branch, w.position, (w.close - w.a_close) / nullif(w.atr, 0) AS relative_normal_close, w.rel_high_close, w.rel_close_low,
    w.open_gap, w.rel_candle_height, w.log_volume_sma_ratio, {", ".join(cols)},
    CASE WHEN w.seen = 0 THEN 0.0 ELSE w.sign * ln(1 + w.seen / {MIN[tf]}.0) * least(1.0, w.age / w.seen) END AS extremum_weight
  FROM s_{tf} w {" ".join(joins)})"""


def _dataset_sql() -> str:
    labels = _labels_sql(3)
    # the label query as a CTE next to the branches; both start from the same stacked candles
    body = labels[labels.index(sql_stacked()) + len(sql_stacked()):]
    ctes, final = body.rsplit("\nSELECT", 1)
    lab = f"lab AS (SELECT * FROM (SELECT{final}) WHERE mfe IS NOT NULL AND rer IS NOT NULL)"
    branches = ",".join(_branch_sql(tf, LAYOUT.length(tf)) for tf in LAYOUT.branches)
    rows = ",".join(_rows_sql(tf) for tf in LAYOUT.branches)
    names = ", ".join(["symbol", "anchor", "branch", "position", *ds.FEATURES])
    union = " UNION ALL ".join(f"SELECT {names} FROM rw_{tf}" for tf in LAYOUT.branches)
    whole = sum(LAYOUT.windows.values())
    complete = " AND ".join(f"{f} IS NOT NULL" for f in ds.FEATURES)
    return f"""WITH {sql_stacked()}{ctes}, {lab}, {branches}, {rows}, allrows AS ({union}),
good AS (SELECT symbol, anchor FROM allrows WHERE {complete} GROUP BY 1, 2 HAVING count(*) = {whole})"""


SQL_DATASET = _dataset_sql()


def _dataset(spark, sf):
    return ds.build_dataset(staged(stacked(spark, sf)), LAYOUT)


def _round4(name: str, sql: str | None = None) -> str:
    return f"round(CAST(CAST({sql or name} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {name}"


ROW_COLUMNS = f"""symbol, anchor AS date, branch, position, {", ".join(_round4(f) for f in ds.FEATURES)}"""


def all_rows(samples):
    """Every branch of the samples in long form, rounded."""
    samples, rows = staged(samples), None
    for tf in LAYOUT.branches:
        part = ds.sample_rows(samples, tf).withColumn("branch", F.lit(tf))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(
        *KEY, "branch", F.col("position").cast("long").alias("position"),
        *[(F.round(F.col(f).cast("double"), 4) + F.lit(0.0)).alias(f) for f in ds.FEATURES],
    )


@query("training_sample_rows", f"{SQL_DATASET} SELECT {ROW_COLUMNS} FROM allrows SEMI JOIN good USING (symbol, anchor)")
def training_sample_rows(spark, sf):
    return all_rows(_dataset(spark, sf))


@query("training_samples", f"""{SQL_DATASET}
SELECT l.symbol, l.date, round(mfe, 3) + 0.0 AS mfe, round(rer, 4) + 0.0 AS rer, action FROM lab l SEMI JOIN good g ON g.symbol = l.symbol AND g.anchor = l.date""")
def training_samples(spark, sf):
    samples = _dataset(spark, sf)
    action = F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("none")), F.array_position("action", F.lit(1.0).cast("float")).cast("int"))
    return samples.select(
        *KEY, (F.round(F.col("mfe").cast("double"), 3) + F.lit(0.0)).alias("mfe"),
        (F.round(F.col("rer").cast("double"), 4) + F.lit(0.0)).alias("rer"), action.alias("action"),
    )


@query("training_sample_shapes", f"""{SQL_DATASET}
SELECT count(*) AS samples, 0 AS shape_1h, 0 AS shape_4h, 0 AS shape_1D, 0 AS shape_auxiliary, 0 AS missing_values, 0 AS not_one_action FROM good""")
def training_sample_shapes(spark, sf):
    return ds.shape_violations(_dataset(spark, sf), LAYOUT)


@query("review_samples", f"""{SQL_DATASET},
spread AS (SELECT symbol, anchor, row_number() OVER (PARTITION BY symbol ORDER BY anchor) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS size FROM good),
chosen AS (SELECT symbol, anchor FROM spread WHERE list_contains([floor(i * (size - 1) / 5) for i in range(1, 5)], k))
SELECT {ROW_COLUMNS} FROM allrows SEMI JOIN chosen USING (symbol, anchor)""")
def review_samples(spark, sf):
    return all_rows(ds.evenly_spaced(staged(_dataset(spark, sf)), 4))
