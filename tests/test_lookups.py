from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from tidemark.operators import asof, crossing
from tidemark.operators.asof import asof_channels, asof_join
from tidemark.operators.crossing import first_beating, first_crossing
from tidemark.operators.nearest import nearest_in_prefix, nearest_known
from tidemark.operators.ranges import best_covering, interval_join, islands, overlap_join

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=float(minutes))


def random_times(rng, n, span=4000):
    return sorted(float(m) for m in rng.choice(span, n, replace=False))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("block_s, dense", [(1800, False), (10_000_000, False), (40_000, True)])
def test_asof_matches_pandas(spark, monkeypatch, direction, allow_equal, block_s, dense):
    monkeypatch.setattr(asof, "ROWS_PER_BLOCK", 7)
    rng = np.random.default_rng(5)
    left, right = random_times(rng, 300), random_times(rng, 40)
    ldf = spark.createDataFrame([("a", at(m)) for m in left], "symbol string, date timestamp_ntz")
    rdf = spark.createDataFrame([("a", at(m), i) for i, m in enumerate(right)], "symbol string, date timestamp_ntz, v long")
    got = column(asof_join(ldf, rdf, ["v"], direction=direction, allow_equal=allow_equal, block_s=block_s, dense=dense), "v")
    want = pd.merge_asof(
        pd.DataFrame({"t": left}), pd.DataFrame({"t": right, "v": range(40)}), on="t", direction=direction,
        allow_exact_matches=allow_equal,
    )["v"]
    assert got == [None if pd.isna(v) else int(v) for v in want]


def test_asof_channels_ties_and_missing_times(spark):
    left = spark.createDataFrame([("a", at(10)), ("a", None), ("b", at(10))], "symbol string, date timestamp_ntz")
    right = spark.createDataFrame(
        [("a", at(10), "x", 1), ("a", at(10), "x", 2), ("a", at(3), "y", 9)],
        "symbol string, date timestamp_ntz, kind string, v long",
    )
    out = asof_channels(left, right, ["v"], {"x_": "kind = 'x'", "y_": "kind = 'y'"}, tie=["v"]).collect()
    rows = {(r.symbol, r.date): (r.x_v, r.y_v) for r in out}
    assert rows == {("a", at(10)): (2, 9), ("a", None): (None, None), ("b", at(10)): (None, None)}
    crowd = asof_channels(left.union(left), right, ["v"], {"x_": "kind = 'x'"}, tie=["v"], dense=True).collect()
    assert sorted((r.symbol, str(r.date), r.x_v) for r in crowd if r.x_v) == [("a", str(at(10)), 2)] * 2 and len(crowd) == 6
    ahead = asof_channels(left, right, ["v"], {"x_": None}, tie=["v"], direction="forward").collect()
    assert {(r.symbol, r.date): r.x_v for r in ahead}[("a", at(10))] == 1


def test_first_beating_against_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 10, n).astype(float)
        start, level = rng.integers(0, n + 1, 50), rng.integers(0, 11, 50).astype(float)
        for strict in (True, False):
            got = first_beating(v, start, level, strict)
            for s, lv, g in zip(start, level, got, strict=True):
                hits = [i for i in range(s, n) if (v[i] > lv if strict else v[i] >= lv)]
                assert (hits[0] if hits else None) == (g if g < n else None)


SHAPES = {
    "walk": lambda n, rng: np.cumsum(rng.normal(size=n)),
    "ties": lambda n, rng: rng.integers(0, 6, n).astype(float),
    "falling": lambda n, rng: np.arange(n, 0, -1.0),
    "rising": lambda n, rng: np.arange(n, dtype=float),
    "valley": lambda n, rng: np.abs(np.arange(n) - n // 2).astype(float),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("comparator", ["gt", "le"])
def test_first_crossing_against_a_scan(series, shape, comparator):
    n = 300
    v = SHAPES[shape](n, np.random.default_rng(4))
    df = series(tf="1h", close=list(v))
    out = first_crossing(df, df, "close", "close", comparator, 3600, directions=("right", "left"), block_bars=16)
    got = column(out, "right_crossing_time", "right_crossing_value", "left_crossing_time", "left_crossing_value")
    beats = {"gt": lambda a, b: a > b, "le": lambda a, b: a <= b}[comparator]
    for i, (rt, rv, lt, lv) in enumerate(got):
        right = next((j for j in range(i + 1, n) if beats(v[j], v[i])), None)
        left = next((j for j in range(i - 1, -1, -1) if beats(v[j], v[i])), None)
        assert rt == (None if right is None else at(60 * right)) and rv == (None if right is None else v[right])
        assert lt == (None if left is None else at(60 * left)) and lv == (None if left is None else v[left])


def test_crossing_of_rows_without_level_or_time_and_outside_the_target(spark, series):
    target = series(tf="1h", close=[1, 5, 2, 9])
    base = spark.createDataFrame(
        [("s", at(-60 * 500), 4.0), ("s", None, 4.0), ("s", at(60), None), ("s", at(60), 8.0), ("s", at(60 * 900), 0.0)],
        "symbol string, date timestamp_ntz, level double",
    )
    out = first_crossing(base, target, "level", "close", "gt", 3600, same_time=True, block_bars=2).collect()
    got = {(r.date, r.level): r.right_crossing_time for r in out}
    assert got == {
        (at(-60 * 500), 4.0): at(60), (None, 4.0): None, (at(60), None): None, (at(60), 8.0): at(180),
        (at(60 * 900), 0.0): None,
    }


def test_crossing_with_base_rows_dealt_out(series):
    v = list(np.cumsum(np.random.default_rng(12).normal(size=120)))
    df = series(tf="1h", close=v)
    whole = first_crossing(df, df, "close", "close", "gt", 3600, block_bars=16)
    dealt = first_crossing(df, df, "close", "close", "gt", 3600, block_bars=16, base_parts=3)
    assert column(whole, "right_crossing_time") == column(dealt, "right_crossing_time")


@pytest.mark.parametrize("hours", [3, 40, 1000])
def test_crossing_within_a_time(series, hours):
    n, rng = 300, np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=n))
    df = series(tf="1h", close=list(v))
    out = first_crossing(df, df, "close", "close", "gt", 3600, directions=("right", "left"), block_bars=16, within_s=hours * 3600)
    for i, (right, left) in enumerate(column(out, "right_crossing_time", "left_crossing_time")):
        hits = [next((j for j in order if v[j] > v[i]), None) for order in (range(i + 1, n), range(i - 1, -1, -1))]
        want = [None if j is None or abs(j - i) > hours else at(60 * j) for j in hits]
        assert [right, left] == want


def test_a_block_that_answers_for_a_whole_series_does_so_in_parts(series, monkeypatch, tmp_path):
    def noted(strict):
        search = crossing_search(strict)

        def run(asked, records):
            (tmp_path / str(asked["_id"][0].as_py())).write_text(f"{asked.num_rows} {records.num_rows}")
            return search(asked, records)

        return run

    crossing_search = crossing._far_search
    monkeypatch.setattr(crossing, "_far_search", noted)
    n = 16 * 20
    v = [*np.arange(n, 0, -1.0), *np.repeat(2.0, n), float(n + 1)]  # falls, stays low, and one bar beats everything
    df = series(tf="1h", close=v)
    out = column(first_crossing(df, df, "close", "close", "gt", 3600, block_bars=16), "right_crossing_time")
    assert out[: n - 2] == [at(60 * 2 * n)] * (n - 2) and out[n - 1] == at(60 * n)
    groups = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert len(groups) >= 39 and max(asked for asked, _ in groups) <= 16 and max(rows for _, rows in groups) <= 16


def test_nearest_known_hand_values():
    times, prices = np.array([0, 30, 200]), np.array([100.0, 105.0, 98.0])
    # an anchor at 250 with an hour's wait knows events up to 190; a bar sees only events before it
    got = nearest_known(times, prices, np.array([49, 9, -10]), np.array([101.0, 99.0, 101.0]))
    assert got[0] == 100.0 and got[1] == 100.0 and np.isnan(got[2])
    assert (101 - got[0]) / 2 == 0.5 and (99 - got[1]) / 2 == -0.5


def test_nearest_known_against_a_scan():
    rng = np.random.default_rng(9)
    t, p = np.sort(rng.integers(0, 200, 60)), rng.integers(0, 15, 60).astype(float)
    cut, val = rng.integers(-5, 210, 200), rng.integers(-2, 18, 200) + rng.choice([0, 0.5], 200)
    got = nearest_known(t, p, cut, val)
    for c, x, g in zip(cut, val, got, strict=True):
        known = [q for s, q in zip(t, p, strict=True) if s <= c]
        if not known:
            assert np.isnan(g)
        else:
            assert g == known[int(np.argmin([abs(x - q) for q in known]))]


def test_nearest_in_prefix_over_blocks(spark, series):
    rng = np.random.default_rng(2)
    df = series(tf="1h", close=list(rng.normal(size=120)))
    events = [(float(m), float(rng.normal())) for m in range(30, 7000, 517)]
    pool = spark.createDataFrame([("s", "e", at(m), p) for m, p in events], "symbol string, channel string, time timestamp_ntz, price double")
    out = nearest_in_prefix(df, pool, "close", {"e": "date"}, 3600, block_bars=16)
    for i, (close, near) in enumerate(column(out, "close", "near_e")):
        known = [p for m, p in events if m <= 60 * i]
        assert near == (min(known, key=lambda p: abs(p - close)) if known else None)


def test_interval_and_overlap_join(spark):
    rng = np.random.default_rng(8)
    spans = [(float(a), float(a + rng.integers(1, 300))) for a in rng.integers(0, 3000, 40)]
    iv = spark.createDataFrame([("a", at(s), at(e), i) for i, (s, e) in enumerate(spans)], "symbol string, start timestamp_ntz, end timestamp_ntz, i long")
    pts = spark.createDataFrame([("a", at(m), m) for m in range(0, 3300, 50)], "symbol string, date timestamp_ntz, m long")
    got = {(r.m, r.i) for r in interval_join(pts, iv, ["symbol"], "date", "start", "end", 3600, ["i"]).collect()}
    assert got == {(m, i) for m in range(0, 3300, 50) for i, (s, e) in enumerate(spans) if s <= m <= e}
    pairs = [(r.i, r.other_i) for r in overlap_join(iv, iv, ["symbol"], 3600, ["i"]).collect()]
    want = [(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if a[0] < b[1] and a[1] > b[0]]
    assert sorted(pairs) == sorted(want)
    groups = islands(iv, ["symbol"], "start", "end", block_s=3600).select("i", "island").collect()
    reach, island, want = None, None, {}
    for s, e, i in sorted((s, e, i) for i, (s, e) in enumerate(spans)):
        if reach is None or s >= reach:
            island = s
        reach = e if reach is None else max(reach, e)
        want[i] = at(island)
    assert {r.i: r.island for r in groups} == want


@pytest.mark.parametrize("cells", [2, 7, 256])
def test_best_covering_against_a_scan(spark, cells):
    rng = np.random.default_rng(6)
    spans = [(float(a), float(a + rng.integers(1, 8)), int(rng.integers(0, 4))) for a in rng.integers(0, 60, 50)]
    values = [float(v) for v in rng.integers(0, 70, 80)]
    iv = spark.createDataFrame([("a", lo, hi, r, i) for i, (lo, hi, r) in enumerate(spans)], "symbol string, lo double, hi double, r int, i int")
    pts = spark.createDataFrame([("a", v, k) for k, v in enumerate(values)], "symbol string, v double, k int")
    out = best_covering(pts, iv, ["symbol"], "v", "lo", "hi", [F.col("r"), -F.col("i")], ["i"], cells)
    for row in out.collect():
        fits = [(r, -i) for i, (lo, hi, r) in enumerate(spans) if lo < row.v < hi]
        assert row.i == (-max(fits)[1] if fits else None)


def test_best_covering_of_flat_and_dear_markets(spark):
    rng = np.random.default_rng(16)
    spans, values = [], []
    for symbol, base, step in (("flat", 100.0, 1e-4), ("dear", 4e7, 900.0), ("wide", 5.0, 1.0)):
        lows = base + step * rng.integers(0, 200, 300)
        spans += [(symbol, float(lo), float(lo + step * rng.integers(1, 40)), int(r), i) for i, (lo, r) in enumerate(zip(lows, rng.integers(0, 3, 300), strict=True))]
        values += [(symbol, float(base + step * v), k) for k, v in enumerate(rng.integers(0, 240, 200))]
    iv = spark.createDataFrame(spans, "symbol string, lo double, hi double, r int, i int")
    pts = spark.createDataFrame(values, "symbol string, v double, k int")
    rows = best_covering(pts, iv, ["symbol"], "v", "lo", "hi", [F.col("r"), -F.col("i")], ["i"], 64).collect()
    assert len(rows) == 600
    for row in rows:
        fits = [(r, -i) for symbol, lo, hi, r, i in spans if symbol == row.symbol and lo < row.v < hi]
        assert row.i == (-max(fits)[1] if fits else None)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("allow_equal", [True, False])
def test_bar_join_is_the_as_of_join_of_gap_free_bars(spark, series, direction, allow_equal):
    rng = np.random.default_rng(7)
    times = sorted([*(float(m) for m in rng.integers(-200, 1800, 80)), *(60.0 * h + s for h in range(0, 30, 3) for s in (0, 1 / 60))])
    left = spark.createDataFrame([("s", at(m)) for m in times] + [("s", None), ("other", at(5))], "symbol string, date timestamp_ntz")
    bars = series(tf="1h", close=list(range(24))).withColumn("start", F.col("date"))
    options = {"direction": direction, "allow_equal": allow_equal}
    by_bar = asof.bar_join(left, bars, ["start", "close"], "1h", **options).collect()
    by_time = asof_join(left, bars, ["start", "close"], **options).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(by_bar, key=key) == sorted(by_time, key=key) and len(by_bar) == len(times) + 2


def test_gap_runs_over_blocks(spark):
    from tidemark.operators.validate import gap_runs

    missing = [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 16, 31, 32, 47]
    rows = spark.createDataFrame([(s, b, at(60 * b)) for s in "ab" for b in missing], "symbol string, bar long, date timestamp_ntz")
    got = sorted((r.symbol, r.start, r.end, r.bars) for r in gap_runs(rows.withColumn("bar", F.col("bar") + 473352), "1h", size=8).collect())
    want = [(0, 0), (3, 11), (15, 16), (31, 32), (47, 47)]
    assert got == [(s, at(60 * a), at(60 * b), b - a + 1) for s in "ab" for a, b in want]
