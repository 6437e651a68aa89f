import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import column, zigzag
from tidemark.operators.blocks import filled, framed, numbered, running
from tidemark.operators.smoothing import add_atr, add_ewm, add_rma, ema_alpha
from tidemark.plans.features import add_log_sma_volume, add_relative_candle, add_volume_rma


def test_volume_over_rma(series):
    df = series(volume=[10, 20, 30, 40])
    out = column(add_volume_rma(df, 2), "volume_atr")
    assert out[0] is None
    assert out[1:] == pytest.approx([1.2, 1.2352941176, 1.2244897959])


def test_zero_volume_gives_no_ratio(series):
    assert column(add_volume_rma(series(volume=[0] * 4), 2), "volume_atr") == [None] * 4


def test_log_sma_volume(series):
    out = column(add_log_sma_volume(series(volume=[10, 20, 30, 40]), 2), "log_volume_sma_ratio")
    assert out[0] is None
    assert out[1:] == pytest.approx([math.log(20 / 15), math.log(30 / 25), math.log(40 / 35)])
    assert column(add_log_sma_volume(series(volume=[7] * 4), 2), "log_volume_sma_ratio")[1:] == pytest.approx([0] * 3)


def test_relative_candle(series):
    out = add_relative_candle(series(**zigzag(5)))
    assert column(out, "rel_close") == pytest.approx([102, 106.2, 108, 112.2, 114])
    assert column(out, "rel_high_close") == pytest.approx([3, 4.8, 3, 4.8, 3])
    assert column(out, "rel_close_low") == pytest.approx([7, 11.2, 7, 11.2, 7])
    gaps = column(out, "open_gap")
    assert gaps[0] is None and gaps[1:] == pytest.approx([-2.2] * 4)
    assert column(out, "rel_candle_height") == pytest.approx([10, 16, 10, 16, 10])


@pytest.mark.parametrize("length", [2, 14])
def test_exponential_means_match_pandas_over_many_blocks(series, length):
    x = np.random.default_rng(3).uniform(1, 100, 5000)
    x[[5, 77, 400]] = np.nan
    df = series(volume=[None if np.isnan(v) else v for v in x])
    got = np.array([np.nan if v is None else v for v in column(add_rma(df, "volume", length, "m"), "m")])
    want = pd.Series(x).ewm(alpha=1 / length, min_periods=length).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-10)
    got = column(add_ewm(df, {"m": (F.col("volume"), length)}, ema_alpha(length)), "m")
    want = pd.Series(x).ewm(span=length, min_periods=length).mean().to_numpy()
    np.testing.assert_allclose(np.array([np.nan if v is None else v for v in got]), want, rtol=1e-10)


@pytest.mark.parametrize("holes", [(40, 4000), (1, 4990), (0, 4000), (700, 2300)])
@pytest.mark.parametrize("length", [14, 30])
def test_exponential_means_outlive_any_gap(series, length, holes):
    x = np.random.default_rng(4).uniform(1, 100, 5000)
    x[holes[0] : holes[1]] = np.nan
    df = series(volume=[None if np.isnan(v) else v for v in x])
    got = np.array([np.nan if v is None else v for v in column(add_rma(df, "volume", length, "m"), "m")])
    want = pd.Series(x).ewm(alpha=1 / length, min_periods=length).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_atr_counts_from_the_second_bar(series):
    df = series(high=[3, 5, 9, 8], low=[1, 4, 6, 2], close=[2, 5, 7, 3])
    # true ranges: none, 3, 4, 6
    assert column(add_atr(df, 2), "atr")[:2] == [None, None]
    assert column(add_atr(df, 2), "atr")[2] == pytest.approx((4 + 3 * 0.5) / 1.5)


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_frames_do_not_depend_on_the_block_size(series, size):
    x = list(np.random.default_rng(1).normal(size=200))
    df = series(close=x)

    def build(rows, w):
        return rows.withColumns(
            {"back": F.sum("close").over(w.rowsBetween(-4, 0)), "ahead": F.max("close").over(w.rowsBetween(1, 6))}
        )

    out = framed(df, build, before=4, after=6, size=size)
    back = pd.Series(x).rolling(5, min_periods=1).sum()
    assert column(out, "back") == pytest.approx(list(back))
    assert column(out, "ahead")[:-1] == pytest.approx([max(x[i + 1 : i + 7]) for i in range(199)])


def test_running_values_numbers_and_fills_over_blocks(series):
    x = list(np.random.default_rng(2).normal(size=300))
    df = series(close=x, gap=[v if i % 37 == 5 else None for i, v in enumerate(x)])
    out = running(df, {"s": ("sum", "close"), "hi": ("max", "close")}, block_s=3600)
    assert column(out, "s") == pytest.approx(list(np.cumsum(x)))
    assert column(out, "hi") == pytest.approx(list(np.maximum.accumulate(x)))
    later = running(df, {"later": ("min", "close")}, forward=False, inclusive=False, block_s=3600)
    assert column(later, "later")[:-1] == pytest.approx([min(x[i + 1 :]) for i in range(299)])
    assert column(later, "later")[-1] is None
    assert column(numbered(df.drop("bar"), block_s=3600), "bar") == list(range(300))
    got = column(filled(df, ["gap"], block_s=3600), "gap")
    assert [v for v in got if v is not None] == pytest.approx(list(pd.Series([r if i % 37 == 5 else None for i, r in enumerate(x)]).ffill().dropna()))
    back = column(filled(df, ["gap"], forward=False, block_s=3600), "gap")
    assert back[:5] == [x[5]] * 5
