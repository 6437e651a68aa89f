"""Forward-looking labels: favourable and adverse excursions over a fixed horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import TF_MINUTES
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import framed
from tidemark.operators.smoothing import add_atr
from tidemark.operators.windows import frame_argmax, frame_argmin, frame_array, frame_max, frame_min, full

HORIZON_BARS = 48
ATR_FLOOR_LENGTH = 255
OM_GATE = 5.0
EPS = 2.220446049250313e-16


def label_floor(
    base: DataFrame, floor_candles: DataFrame, base_tf: str, floor_tf: str, length: int, as_reference: bool
) -> DataFrame:
    """ATR of the last floor candle that is closed when the base candle closes.

    `as_reference=True` matches on the candle's start, so a forming candle is taken as well.
    """
    atr = add_atr(floor_candles, length, out="atr_floor").where("atr_floor is not null")
    shift = 0 if as_reference else (TF_MINUTES[floor_tf] - TF_MINUTES[base_tf]) * 60
    return asof_join(base, atr, ["atr_floor"], left_time=plus_seconds("date", -shift))


def _excursions(rows: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    rows = rows.withColumns(
        {
            "_whole": full(F.col("high"), w, 1, n),
            "_low1": F.lead("low").over(w),
            "_high1": F.lead("high").over(w),
            "_top": frame_max("high", w, 1, n),
            "_bottom": frame_min("low", w, 1, n),
            "_top_at": frame_argmax("high", w, 1, n),
            "_bottom_at": frame_argmin("low", w, 1, n),
            "_lows": frame_array("low", w, 1, n),
            "_highs": frame_array("high", w, 1, n),
        }
    ).where("_whole")
    worst_low = F.array_min(F.slice("_lows", F.lit(1), F.col("_top_at").cast("int") + 1))
    worst_high = F.array_max(F.slice("_highs", F.lit(1), F.col("_bottom_at").cast("int") + 1))
    zero = F.lit(0.0)
    return rows.withColumns(
        {
            "mfe_long": F.greatest(zero, F.col("_top") - F.col("_low1")),
            "mfe_short": F.greatest(zero, F.col("_high1") - F.col("_bottom")),
            "_adverse_long": F.greatest(zero, F.col("_low1") - worst_low),
            "_adverse_short": F.greatest(zero, worst_high - F.col("_high1")),
        }
    )


def excursion_labels(
    base: DataFrame,
    floor_candles: DataFrame,
    base_tf: str = "5min",
    floor_tf: str = "15min",
    horizon: int = HORIZON_BARS,
    floor_length: int = ATR_FLOOR_LENGTH,
    gate: float = OM_GATE,
    as_reference: bool = False,
) -> DataFrame:
    """Per anchor the better direction's `mfe`, its `rer` (risk over net reward, clipped), and the action.

    The entry is the best price of the next bar. The adverse move counts up to the bar of the best price and is
    never taken below the floor ATR. Anchors without a whole horizon are dropped; without a floor the values are
    NULL.
    """
    horizons = framed(base, lambda rows, w: _excursions(rows, w, horizon), after=horizon)
    rows = label_floor(horizons, floor_candles, base_tf, floor_tf, floor_length, as_reference)
    has_floor = F.col("atr_floor").isNotNull()

    def mae(c: str) -> Column:
        return F.when(has_floor, F.greatest(F.col(c), F.col("atr_floor")))

    rows = rows.withColumns({"mae_long": mae("_adverse_long"), "mae_short": mae("_adverse_short")})
    rows = rows.withColumns(
        {
            "om_long": F.try_divide("mfe_long", "mae_long"),
            "om_short": F.try_divide("mfe_short", "mae_short"),
        }
    )
    is_long = F.col("om_long") >= F.col("om_short")
    best = F.when(is_long, F.col("om_long")).otherwise(F.col("om_short"))
    bound = 1 / (1 + gate - 1)
    rows = rows.withColumns(
        {
            "mfe": F.when(has_floor, F.when(is_long, F.col("mfe_long")).otherwise(F.col("mfe_short"))),
            "mae": F.when(is_long, F.col("mae_long")).otherwise(F.col("mae_short")),
            "action": F.when(best > gate, F.when(is_long, "long").otherwise("short")).otherwise("none"),
        }
    )
    rer = F.col("mae") / (F.col("mfe") - F.col("mae") + EPS)
    return rows.withColumn(
        "rer", F.when(rer.isNotNull(), F.least(F.greatest(rer, F.lit(0.0)), F.lit(bound)))
    ).select(
        "symbol", "timeframe", "bar", "date", "mfe", "rer", "action",
        *[F.when(F.col("action") == a, 1.0).otherwise(0.0).alias(f"action_{a}") for a in ("long", "short", "none")],
    )


def split_by_time(df: DataFrame, fraction: float = 0.1, keys=("symbol",), order: str = "date") -> DataFrame:
    """Mark the last `fraction` of each series (at least one row) as validation, the rest as training."""
    from tidemark.operators.blocks import numbered

    rows = numbered(df, keys, (order,), name="_n")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    held_out = F.greatest(F.lit(1), F.floor(F.col("_size") * fraction))
    return (
        rows.join(sizes, list(keys))
        .withColumn("split", F.when(F.col("_n") >= F.col("_size") - held_out, "validation").otherwise("train"))
        .drop("_n", "_size")
    )


def next_bar_targets(df: DataFrame) -> DataFrame:
    """Close less open of the bar, its class on the next bar, and the next close; rows without a next bar go."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("target", F.lead(F.col("close") - F.col("open")).over(w))
        return rows.withColumns(
            {"target_class": F.when(F.col("target") > 0, 1).otherwise(0), "target_next_close": F.lead("close").over(w)}
        ).where("target is not null")

    return framed(df, build, after=1)


def supervised_pairs(df: DataFrame, window: int, value: str = "close") -> DataFrame:
    """`window` past values as an array and the value of the next bar."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {"x": frame_array(value, w, -window, -1), "y": F.col(value)}
        ).where(F.size("x") == window)

    return framed(df, build, before=window)
