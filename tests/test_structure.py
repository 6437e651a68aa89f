import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import column, zigzag
from tidemark.functions import ladder as ld
from tidemark.plans import profit as pf
from tidemark.plans.features import extremum_weight, observed_extremum
from tidemark.plans.labels import excursion_labels
from tidemark.plans.tops import add_true_extremum, find_tops

START = datetime(2024, 1, 1)


def test_ladder(spark):
    df = spark.createDataFrame([(v,) for v in (4.9, 5.0, 59.9, 60.0, math.inf, 100000.0)] + [(None,)], "x double")
    assert [r[0] for r in df.select(ld.floor_to_ladder(F.col("x"))).collect()] == [0, 5, 15, 60, 525600, 43200, None]
    assert [ld.shifted(t, 2) for t in ("5min", "1h", "1W")] == ["1h", "1D", "4M"]
    assert [ld.shifted(t, 3) for t in ("5min", "1h", "1W")] == ["4h", "1W", "1Y"]
    assert ld.shifted("1Y", 2) is None


def test_spike_and_dip(series):
    high, low = [5.0] * 11, [1.0] * 11
    high[5], low[2] = 20, -5
    rows = column(add_true_extremum(series(high=high, low=low), "5min"), "extremum_sign", "true_extremum_tf_minutes")
    assert rows[5] == (1, 525600) and rows[2] == (-1, 525600) and rows[4] == (1, 5)


def test_flat_run_and_time_gap(series):
    out = add_true_extremum(series(high=[5, 10, 10, 10, 5], low=[1] * 5), "5min")
    assert column(out, "true_peak_reach_minutes")[1:4] == [5, 5, 5]
    dates = [START, START + timedelta(minutes=5), START + timedelta(minutes=65)]
    gap = add_true_extremum(series(high=[5, 20, 5], low=[1, 1, 1], dates=dates), "5min")
    assert column(gap, "true_peak_reach_minutes")[0] == 5


def test_causal_cap(series):
    high, low = [5.0] * 25, [1000.0] * 25
    high[5], high[7], low[5], low[18] = 100, 150, 50, 40
    ext = add_true_extremum(series(high=high, low=low), "5min")
    assert column(ext, "true_peak_reach_minutes", "true_valley_reach_minutes")[5] == (10, 65)
    anchor = F.lit(START + timedelta(minutes=75)).cast("timestamp_ntz")
    seen = ext.withColumn("seen", observed_extremum(F.col("true_extremum_tf_minutes"), anchor, "date"))
    assert column(seen, "seen")[5] == 15


def test_future_does_not_change_what_an_anchor_sees(series):
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=30))
    anchor = F.lit(START + timedelta(minutes=75)).cast("timestamp_ntz")

    def seen(shift):
        moved = walk.copy()
        moved[16:] += shift
        ext = add_true_extremum(series(high=list(moved + 1), low=list(moved - 1)), "5min", block_bars=8)
        size = observed_extremum(F.col("true_extremum_tf_minutes"), anchor, "date")
        return column(ext.withColumn("seen", size), "seen")[:16]

    assert seen(0) == seen(1000) == seen(-1000)


def test_extremum_weight_hand_values(spark):
    df = spark.createDataFrame([(START, 1, 240.0), (START + timedelta(minutes=100), -1, 1440.0)], "date timestamp_ntz, s int, r double")
    anchor = F.lit(START + timedelta(minutes=500)).cast("timestamp_ntz")
    got = [r[0] for r in df.orderBy("date").select(extremum_weight(F.col("s"), F.col("r"), anchor, "date", 5.0)).collect()]
    assert got == pytest.approx([math.log1p(48), -math.log1p(48)])


def test_tops_of_equal_runs_count_once(series):
    df = series(high=[1, 3, 3, 2, 5, 4], low=[0, 1, 1, 0.5, 0.7, 0.2])
    tops = find_tops(df)
    assert column(tops.where("top_type = 'peak'"), "high") == [3, 5]
    assert column(tops.where("top_type = 'valley'"), "low") == [0.5]


@pytest.mark.parametrize("kind", ["long", "short", "none"])
def test_labels_of_monotone_series(series, kind):
    step = {"long": 5.0, "short": -5.0, "none": 0.0}[kind]
    mid = [10_000 + step * i for i in range(68)]
    five = series(high=[m + 0.5 for m in mid], low=[m - 0.5 for m in mid], close=mid)
    past = [START - timedelta(minutes=15 * (600 - i)) for i in range(600)]
    quarter = series(tf="15min", dates=past, high=[1.5] * 600, low=[0.5] * 600, close=[1.0] * 600)
    rows = excursion_labels(five, quarter).collect()
    assert len(rows) == 20
    assert {r.action for r in rows} == {kind}
    for r in rows:
        assert r.mfe >= 0 and 0 <= r.rer <= 0.2
        assert r.action_long + r.action_short + r.action_none == 1


def test_label_does_not_look_past_its_horizon(series):
    rng = np.random.default_rng(3)
    mid = 100 + np.cumsum(rng.normal(size=120))
    past = [START - timedelta(minutes=15 * (600 - i)) for i in range(600)]
    quarter = series(tf="15min", dates=past, high=[1.5] * 600, low=[0.5] * 600, close=[1.0] * 600)

    def labels(m):
        five = series(high=list(m + 0.5), low=list(m - 0.5), close=list(m))
        return column(excursion_labels(five, quarter, horizon=24), "mfe", "rer", "action")

    moved = mid.copy()
    moved[80:] += 500
    assert labels(mid)[: 80 - 24] == labels(moved)[: 80 - 24]


def test_profit_chain_on_the_zigzag(series):
    df = series(**zigzag(12))
    out = pf.add_sub_horizons(pf.add_horizon_extremes(df, 5, 1, 4), 4, 2)
    out = pf.add_stop_distance(pf.add_drawdowns(out, 5, 2))
    out = pf.add_profit(out, 0.0001, 0.005, 2.0)
    none = [None] * 5
    assert column(out, "worst_long_open") == [105, 111, 111, 117, 117, 123, 123, 129, 129, 135, 135, 141]
    assert column(out, "max_high") == [123, 123, 129, 129, 135, 135, 141] + none
    assert column(out, "min_low") == [101, 101, 107, 107, 113, 113, 119] + none
    assert column(out, "max_high_distance") == [4, 3, 4, 3, 4, 3, 4] + none
    assert column(out, "min_low_distance") == [1] * 7 + none
    assert column(out, "q1_max_high_distance") == [0, 1] * 5 + [None] * 2
    assert column(out, "q2_max_high")[:8] == [117, 123, 123, 129, 129, 135, 135, 141]
    assert column(out, "max_high_quantile")[:7] == pytest.approx([1.6, 1.2] * 3 + [1.6])
    assert column(out, "quantile_long_min_low") == [95, 101, 101, 107, 107, 113, 113] + none
    assert column(out, "long_drawdown") == [10] * 7 + none
    assert column(out, "short_drawdown") == [16, 22, 16, 22, 16, 22, 16] + none
    assert column(out, "long_sl_distance") == [10] * 7 + none
    assert set(column(out, "short_signal")[:7]) == {0.0}
    first = column(out, "weighted_long_profit", "long_risk")[0]
    assert first[0] == pytest.approx(18 - 4 * 0.0001 - 0.005) and first[1] == pytest.approx(10 / first[0])
    assert not [c for c in pf.drop_sub_horizons(out).columns if c.startswith("q1")]
