"""Samples against a plain version, one bar of one window at a time, at the live layout."""

import math
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions.ladder import RUNGS, TF_MINUTES, shifted
from tidemark.plans import dataset as ds

START = datetime(2020, 1, 6)  # a Monday


def minute(date):
    return (date - datetime(1970, 1, 1)).total_seconds() / 60


def bar_number(date, tf):
    return math.floor((minute(date) - (5760 if tf == "1W" else 0)) / TF_MINUTES[tf])


def bar_start(bar, tf):
    return bar * TF_MINUTES[tf] + (5760 if tf == "1W" else 0)


def random_facts(rng, layout, anchors):
    """Facts of every bar the windows of `anchors` need, as a dictionary by (branch, bar)."""
    known = {}
    for tf, length in layout.windows.items():
        off = timedelta(minutes=TF_MINUTES[tf] - TF_MINUTES[layout.branches[0]])
        first, last = (bar_number(d - off, tf) for d in (anchors[0], anchors[-1]))
        for bar in range(first - length + 1, last + 1):
            fact = {c: float(v) for c, v in zip(ds._FACTS, rng.uniform(1, 5, len(ds._FACTS)), strict=True)}
            fact["t"] = float(bar_start(bar, tf))
            fact["sign"], fact["size"] = float(rng.integers(-1, 2)), float(rng.choice([0, 5, 60, 1440, 525600]))
            for n in (2, 3):
                for k in ("peak", "valley"):
                    fact[f"p{n}_{k}_last"] = fact["t"] - rng.uniform(0, 9000)
                    fact[f"p{n}_{k}_time"] = fact["t"] - rng.uniform(-50, 3 * TF_MINUTES[shifted(tf, n)])
                    if rng.random() < 0.2:
                        fact[f"p{n}_{k}_near"] = fact[f"p{n}_{k}_last"] = math.nan
                    if rng.random() < 0.2:
                        fact[f"p{n}_{k}_price"] = fact[f"p{n}_{k}_time"] = math.nan
            known[tf, bar] = fact
    return known


def plain(x, tf, a_time, a_close):
    age = a_time - x["t"]
    seen = min(x["size"], max([TF_MINUTES[r] for r in RUNGS if TF_MINUTES[r] <= age], default=0))
    weight = 0.0 if seen == 0 else x["sign"] * math.log1p(seen / TF_MINUTES[tf]) * min(1.0, age / seen)
    prices, times = [], []
    for n in (2, 3):
        width = TF_MINUTES[shifted(tf, n)]
        for k in ("peak", "valley"):
            near, last, price, time = (x[f"p{n}_{k}_{c}"] for c in ("near", "last", "price", "time"))
            fresh = not math.isnan(time) and time <= a_time - width
            if fresh and (math.isnan(near) or abs(x["close"] - price) < abs(x["close"] - near)):
                near = price
            prices.append(0.0 if math.isnan(near) else (x["close"] - near) / x[f"p{n}_atr"])
            last = time if fresh else last
            times.append(0.0 if math.isnan(last) else math.log1p(max(0.0, x["t"] - last) / width))
    return [(x["close"] - a_close) / x["atr"], *[x[c] for c in ds.STATIC], *prices, *times, weight]


def test_samples_at_the_live_layout():
    layout, rng = ds.Layout(), np.random.default_rng(2)
    assert layout.windows == {"5min": 256, "15min": 128, "1h": 128, "4h": 128, "1D": 128, "1W": 128}
    dates = [START + timedelta(minutes=5 * i) for i in range(40)]
    known = random_facts(rng, layout, dates)
    gone = next(b for tf, b in known if tf == "5min") + 2  # a bar is missing: three anchors lack a whole window
    del known["5min", gone]
    known["1h", max(b for tf, b in known if tf == "1h")]["atr"] = 0.0  # and some see a bar without a feature
    closes = rng.uniform(1, 5, len(dates))
    anchors = pa.table({
        "symbol": ["s"] * len(dates), "date": pa.array(dates, pa.timestamp("us")), "mfe": rng.uniform(0, 1, len(dates)),
        "rer": rng.uniform(0, 0.2, len(dates)), "action_long": [1.0] * len(dates), "action_short": [0.0] * len(dates),
        "action_none": [0.0] * len(dates), "_close": closes, "_time": [minute(d) for d in dates],
    })
    order = rng.permutation(len(known))
    rows = [(tf, bar, fact) for (tf, bar), fact in known.items()]
    facts = pa.table({
        "branch": [rows[i][0] for i in order], "bar": [rows[i][1] for i in order],
        **{c: pa.array([rows[i][2][c] for i in order], pa.float64(), from_pandas=True) for c in ds._FACTS}})
    got = {r["date"]: r for r in ds._assembled(layout)(anchors, facts).to_pylist()}
    expected = 0
    for date, close in zip(dates, closes, strict=True):
        windows = {}
        for tf, length in layout.windows.items():
            last = bar_number(date - timedelta(minutes=TF_MINUTES[tf] - 5), tf)
            window = [known.get((tf, b)) for b in range(last - length + 1, last + 1)]
            windows[tf] = window if all(w and w["atr"] for w in window) else None
        if None in windows.values():
            assert date not in got
            continue
        expected += 1
        for tf in (layout.branches if expected < 4 else ["1W"]):
            want = [plain(x, tf, minute(date), close) for x in windows[tf]]
            assert np.allclose(got[date][f"branch_{tf}"], want, rtol=1e-5, atol=1e-6)
        assert len(got[date]["auxiliary"]) == 90 and got[date]["auxiliary"][:15] == got[date]["branch_5min"][-1]
    assert len(got) == expected and 10 < expected < 38


@pytest.mark.parametrize("tf", ["5min", "4h", "1W"])
def test_every_window_is_whole_in_its_block(spark, tf):
    length, block_bars = 5, 7
    dates = [START + timedelta(minutes=5 * i) for i in range(0, 12_000, 11)]
    bars = spark.range(bar_number(dates[0], tf) - 20, bar_number(dates[-1], tf) + 2).withColumnRenamed("id", "bar")
    dealt = {(r["_block"], r["bar"]) for r in ds.dealt_facts(bars, tf, length, "5min", block_bars).collect()}
    for date in dates:
        last = bar_number(date - timedelta(minutes=TF_MINUTES[tf] - 5), tf)
        block = bar_number(date, "5min") // block_bars
        assert all((block, b) in dealt for b in range(last - length + 1, last + 1))
    n = bars.count()
    most = length * TF_MINUTES[tf] / 5 / block_bars + 2  # blocks a bar's anchors lie in
    assert len(dealt) <= n * most
