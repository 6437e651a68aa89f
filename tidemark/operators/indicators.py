"""Classic indicators on candles `(symbol, timeframe, bar, date, open, high, low, close, volume)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.operators.blocks import BLOCK_BARS, framed, running
from tidemark.operators.smoothing import add_ewm, ema_alpha, rma_alpha, sma
from tidemark.operators.windows import frame_array, frame_max, frame_min, full, mid, slope

# Usual indicator lengths.
CCI_LENGTH, RSI_LENGTH, MFI_LENGTH, BBANDS_LENGTH, BBANDS_STD = 14, 14, 14, 5, 2.0
ICHIMOKU = (9, 26, 52)
SCALE_WINDOW = 288


def _size(reach: int) -> int:
    return max(BLOCK_BARS, 8 * reach)


def add_obv(df: DataFrame, out: str = "obv") -> DataFrame:
    """On-balance volume: volume added on a rise, taken off on a fall, kept on no change; the first bar adds."""

    def signed(rows: DataFrame, w: WindowSpec) -> DataFrame:
        step = F.signum(F.col("close") - F.lag("close").over(w))
        return rows.withColumn("_signed", F.coalesce(step, F.lit(1.0)) * F.col("volume"))

    return running(framed(df, signed, before=1), {out: ("sum", "_signed")}).drop("_signed")


def scaled(value: str, w: WindowSpec, window: int = SCALE_WINDOW) -> Column:
    """10/3 of the z-score over the last `window` bars; a zero deviation counts as 1e-9."""
    frame = w.rowsBetween(-(window - 1), 0)
    std = F.stddev_pop(value).over(frame)
    z = (F.col(value) - F.avg(value).over(frame)) / F.when(std == 0, 1e-9).otherwise(std)
    return F.lit(10.0) * z / F.lit(3.0)


def add_cci(df: DataFrame, length: int = CCI_LENGTH, out: str = "cci") -> DataFrame:
    """Typical price less its mean, over 0.015 mean absolute deviations."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        rows = rows.withColumns({"_mean": sma(F.col("_tp"), w, length), "_all": frame_array("_tp", w, 1 - length, 0)})
        deviation = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / length
        return rows.withColumn(
            out, F.try_divide(F.col("_tp") - F.col("_mean"), F.lit(0.015) * deviation)
        ).drop("_tp", "_mean", "_all")

    return framed(df, build, before=length - 1)


def add_rsi(df: DataFrame, length: int = RSI_LENGTH, out: str = "rsi") -> DataFrame:
    """Share of the gains in gains plus losses, both as Wilder's means, in percent."""
    alpha = rma_alpha(length)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("_step", F.col("close") - F.lag("close").over(w))

    none = F.lit(0.0) * F.col("_step")
    sides = {"_gain": (F.greatest(F.col("_step"), none), length), "_loss": (F.greatest(-F.col("_step"), none), length)}
    rows = add_ewm(framed(df, build, before=1), sides, alpha)
    share = F.try_divide(100 * F.col("_gain"), F.col("_gain") + F.col("_loss"))
    return rows.withColumn(out, share).drop("_step", "_gain", "_loss")


def add_mfi(df: DataFrame, length: int = MFI_LENGTH, out: str = "mfi") -> DataFrame:
    """Share of the money flow on rising typical prices, in percent."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        rows = rows.withColumn("_step", F.coalesce(F.col("_tp") - F.lag("_tp").over(w), F.lit(0.0)))
        frame = w.rowsBetween(1 - length, 0)
        flow = F.col("_tp") * F.col("volume")
        up = F.sum(F.when(F.col("_step") > 0, flow).otherwise(0.0)).over(frame)
        down = F.sum(F.when(F.col("_step") < 0, flow).otherwise(0.0)).over(frame)
        rows = rows.withColumns({"_up": up, "_down": down, "_full": full(F.col("_tp"), w, 1 - length, 0)})
        return rows.withColumn(
            out, F.when(F.col("_full"), F.try_divide(100 * F.col("_up"), F.col("_up") + F.col("_down")))
        ).drop("_tp", "_step", "_up", "_down", "_full")

    return framed(df, build, before=length)


def add_bbands(df: DataFrame, length: int = BBANDS_LENGTH, std: float = BBANDS_STD) -> DataFrame:
    """Mean of the close and the bands `std` population deviations around it, with their width."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(1 - length, 0)
        whole = full(F.col("close"), w, 1 - length, 0)
        rows = rows.withColumns(
            {
                "bbands_m": F.when(whole, F.avg("close").over(frame)),
                "_off": F.when(whole, F.stddev_pop("close").over(frame) * std),
            }
        )
        return rows.withColumns(
            {
                "bbands_u": F.col("bbands_m") + F.col("_off"),
                "bbands_l": F.col("bbands_m") - F.col("_off"),
                "bollinger_width": 2 * F.col("_off"),
            }
        ).drop("_off")

    return framed(df, build, before=length - 1)


def add_ichimoku(df: DataFrame, lengths: tuple[int, int, int] = ICHIMOKU) -> DataFrame:
    """Conversion, base, both leads (moved `base` bars ahead) and the lag line.

    `ichi_lag` is the close `base` bars later: it looks ahead and must stay out of causal features.
    """
    conv, base, lead = lengths

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumns({"ichi_conv": mid(w, conv), "ichi_base": mid(w, base), "_b": mid(w, lead)})
        rows = rows.withColumn("_a", (F.col("ichi_conv") + F.col("ichi_base")) / 2)
        return rows.withColumns(
            {
                "ichi_lead_a": F.lag("_a", base).over(w),
                "ichi_lead_b": F.lag("_b", base).over(w),
                "ichi_lag": F.lead("close", base).over(w),
            }
        ).drop("_a", "_b")

    return framed(df, build, before=lead - 1 + base, after=base)


def add_classic_indicators(df: DataFrame) -> DataFrame:
    """Scaled OBV and CCI, RSI, MFI, Bollinger bands, Ichimoku."""

    def scale(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({"sc_obv": scaled("obv", w), "sc_cci": scaled("cci", w)})

    out = framed(add_cci(add_obv(df)), scale, before=SCALE_WINDOW - 1, size=_size(SCALE_WINDOW))
    out = add_mfi(add_rsi(out))
    return add_ichimoku(add_bbands(out)).drop("obv", "cci", "bollinger_width")


def add_macd(df: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two EMAs, its own EMA and what is left; each EMA is adjusted and starts when full."""
    out = add_ewm(df, {"_fast": (F.col(value), fast)}, ema_alpha(fast))
    out = add_ewm(out, {"_slow": (F.col(value), slow)}, ema_alpha(slow))
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = add_ewm(out, {"macd_signal": (F.col("macd"), signal)}, ema_alpha(signal))
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_obv_macd(df: DataFrame, sma_length: int = 14, std_length: int = 28, pivot_bars: int = 50) -> DataFrame:
    """MACD of the price moved by the OBV shadow, its slope, and pivots of its rolling extremes."""

    def shadow(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("obv_smooth", sma(F.col("obv"), w, sma_length))
        rows = rows.withColumns({"_gap": F.col("obv") - F.col("obv_smooth"), "_spread": F.col("high") - F.col("low")})
        frame = w.rowsBetween(1 - std_length, 0)
        rows = rows.withColumns(
            {
                "_gap_std": F.when(full(F.col("_gap"), w, 1 - std_length, 0), F.stddev_samp("_gap").over(frame)),
                "_spread_std": F.when(full(F.col("_spread"), w, 1 - std_length, 0), F.stddev_samp("_spread").over(frame)),
            }
        )
        rows = rows.withColumn("_shadow", F.try_divide(F.col("_gap"), F.col("_gap_std")) * F.col("_spread_std"))
        return rows.withColumn(
            "shadow_adjusted_obv",
            F.when(F.col("_shadow") > 0, F.col("high") + F.col("_shadow")).otherwise(F.col("low") + F.col("_shadow")),
        ).drop("_gap", "_spread", "_gap_std", "_spread_std", "_shadow")

    def pivots(rows: DataFrame, w: WindowSpec) -> DataFrame:
        whole = full(F.col("macd"), w, 1 - pivot_bars, 0)
        rows = rows.withColumns(
            {
                "slope": slope("macd", w, 2),
                "max_upper": F.when(whole, frame_max("macd", w, 1 - pivot_bars, 0)),
                "min_lower": F.when(whole, frame_min("macd", w, 1 - pivot_bars, 0)),
            }
        )

        def held(c: str) -> Column:
            two, three = F.lag(c, 2).over(w), F.lag(c, 3).over(w)
            return F.coalesce((F.col(c) == two) & (three.isNull() | (two != three)), F.lit(False))

        return rows.withColumns(
            {
                "pivot_high": held("max_upper"),
                "pivot_low": held("min_lower"),
                "signal_color": F.when(F.col("slope") > 0, "blue").otherwise("red"),
            }
        )

    out = framed(add_obv(df), shadow, before=sma_length + std_length)
    out = add_macd(out, "shadow_adjusted_obv")
    return framed(out, pivots, before=pivot_bars + 3)


# How many bars the mean and deviation of each timeframe look back.
NORMALIZATION_LENGTH = {"1min": 256, "5min": 128, "15min": 128, "1h": 64, "4h": 32, "1D": 16, "1W": 4}


def z_encode(df: DataFrame, tf: str, columns: list[str], length: int | None = None) -> DataFrame:
    """Each column of one timeframe against the EMA mean and the deviation of the bars before it."""
    n = length or NORMALIZATION_LENGTH[tf]
    alpha = ema_alpha(n)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        for c in columns:
            rows = rows.withColumn(f"pre_{c}", F.lag(c).over(w))
            spread = F.stddev_samp(f"pre_{c}").over(w.rowsBetween(1 - n, 0))
            rows = rows.withColumn(f"std_{c}", F.when(full(F.col(f"pre_{c}"), w, 1 - n, 0), spread))
        return rows

    rows = add_ewm(framed(df, build, before=n), {f"mean_{c}": (F.col(f"pre_{c}"), n) for c in columns}, alpha)
    return rows.withColumns({f"n_{c}": F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in columns})


def z_decode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of `z_encode`."""
    return df.withColumns({c: F.col(f"mean_{c}") + F.col(f"std_{c}") * F.col(f"n_{c}") for c in columns})
