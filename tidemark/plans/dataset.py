"""Training samples: per anchor a window of features on each timeframe, all as known when the anchor closes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.clock import epoch_us, plus_seconds
from tidemark.functions.ladder import RUNGS, TF_MINUTES, WEEK_OFFSET_S, bar_of, shifted, start_of_bar
from tidemark.operators.asof import asof_channels
from tidemark.operators.blocks import framed, numbered
from tidemark.operators.nearest import nearest_in_prefix
from tidemark.operators.smoothing import add_atr
from tidemark.plans.features import log_sma_ratio, relative_ratios
from tidemark.plans.labels import excursion_labels
from tidemark.plans.tops import PEAK, VALLEY, add_true_extremum
from tidemark.session import staged

# The features of one candle, in their order.
FEATURES = [
    "relative_normal_close",
    "rel_high_close",
    "rel_close_low",
    "open_gap",
    "rel_candle_height",
    "log_volume_sma_ratio",
    "price_normal_distance_plus2tf_peak",
    "price_normal_distance_plus2tf_valley",
    "price_normal_distance_plus3tf_peak",
    "price_normal_distance_plus3tf_valley",
    "time_distance_plus2tf_peak",
    "time_distance_plus2tf_valley",
    "time_distance_plus3tf_peak",
    "time_distance_plus3tf_valley",
    "extremum_weight",
]
STATIC = FEATURES[1:6]


@dataclass(frozen=True)
class Layout:
    """Timeframes, window lengths and warm-up lengths of a sample. The first timeframe is the anchors'."""

    # The live sample layout.
    windows: dict[str, int] = field(
        default_factory=lambda: {"5min": 256, "15min": 128, "1h": 128, "4h": 128, "1D": 128, "1W": 128}
    )
    lengths: dict[str, int] = field(default_factory=lambda: {"1W": 20})
    default_length: int = 256
    horizon: int = 48
    floor_tf: str = "15min"
    floor_length: int = 255
    gate: float = 5.0

    @property
    def branches(self) -> list[str]:
        return list(self.windows)

    def length(self, tf: str) -> int:
        return self.lengths.get(tf, self.default_length)

    def source(self, target: str) -> str:
        """Events of timeframes that have no candles of their own come from the largest one that has."""
        return target if target in self.windows else self.branches[-1]


def branch_table(candles: DataFrame, tf: str, length: int) -> DataFrame:
    """Candles of one timeframe with ATR, static ratios, and true extremum size and sign."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({**relative_ratios(w), "log_volume_sma_ratio": log_sma_ratio(w, length)})

    out = framed(add_atr(candles, length), build, before=length)
    return add_true_extremum(staged(out), tf)


def extremum_pool(source: DataFrame, target_minutes: float) -> DataFrame:
    """Peaks and valleys of a branch that hold for at least `target_minutes`: `(symbol, kind, time, price)`."""
    kind = F.when(F.col("extremum_sign") == 1, PEAK).when(F.col("extremum_sign") == -1, VALLEY)
    return source.where((F.col("extremum_sign") != 0) & (F.col("true_extremum_tf_minutes") >= target_minutes)).select(
        "symbol", kind.alias("kind"), F.col("date").alias("time"),
        F.when(F.col("extremum_sign") == 1, F.col("high")).otherwise(F.col("low")).alias("price"),
    )


def add_pool_facts(branch: DataFrame, sources: dict[str, DataFrame], tf: str, layout: Layout) -> DataFrame:
    """Per bar what the higher extremes look like from it, whatever anchor asks.

    An anchor may know events up to its time less the target's width. No anchor that sees the bar is older than the
    bar's close, so events up to that cutoff are known to all of them: nearest and last of those are looked up
    here. Two events of a pool lie at least the target's width apart, so at most one more can come between that
    cutoff and the bar; it is kept by itself, and each anchor decides whether it counts.
    """
    base_minutes = TF_MINUTES[layout.branches[0]]
    lookups, pools, channels, cutoffs = [], [], {}, {}

    def look_up(rows: DataFrame, name: str, seconds: int, micros: int = 0) -> None:
        """Rows `(symbol, time, price)` count from `time` plus a delay on; all look-ups then share one pass."""
        since = F.timestamp_micros(epoch_us("time") + seconds * 1_000_000 + micros).cast("timestamp_ntz")
        lookups.append(rows.select("symbol", "time", "price", since.alias("since"), F.lit(name).alias("channel")))
        channels[f"{name}_"] = f"channel = '{name}'"

    for n in (2, 3):
        target = shifted(tf, n)
        width = TF_MINUTES[target]
        source_tf = layout.source(target)
        source = sources[source_tf]
        atr = source.select("symbol", F.col("date").alias("time"), F.col("atr").alias("price"))
        look_up(atr, f"p{n}_atr", TF_MINUTES[source_tf] * 60)
        pool = extremum_pool(source, width)
        for k in (PEAK, VALLEY):
            one = pool.where(F.col("kind") == k)
            look_up(one, f"p{n}_{k}_last", (width + base_minutes - TF_MINUTES[tf]) * 60)
            look_up(one, f"p{n}_{k}_event", 0, micros=1)
            cutoffs[f"p{n}_{k}"] = plus_seconds("date", (TF_MINUTES[tf] - base_minutes - width) * 60)
        pools.append(pool.withColumn("channel", F.concat(F.lit(f"p{n}_"), F.col("kind"))))
    events = staged(reduce(DataFrame.unionByName, lookups))
    out = asof_channels(branch, events, ["time", "price"], channels, right_time="since")
    for name, cutoff in cutoffs.items():
        fresh = F.col(f"{name}_event_time") > cutoff
        out = out.withColumns({c: F.when(fresh, F.col(c)) for c in (f"{name}_event_price", f"{name}_event_time")})
    out = out.withColumnsRenamed({f"p{n}_atr_price": f"p{n}_atr_aligned" for n in (2, 3)})
    return nearest_in_prefix(
        staged(out), pools[0].unionByName(pools[1]), "close", cutoffs, TF_MINUTES[tf] * 60
    )


def minutes(c: str | Column) -> Column:
    return epoch_us(c) / F.lit(60_000_000.0)


# What a bar tells whatever the anchor; times in minutes. `p2_peak_last` is the last peak of the pool two rungs up that all anchors know.
_FACTS = ["t", "close", "atr", *STATIC, "sign", "size", *[
    f"p{n}_{c}" for n in (2, 3) for c in ("atr", *[f"{k}_{x}" for k in (PEAK, VALLEY) for x in ("near", "last", "price", "time")])]]


def branch_facts(facts: DataFrame, tf: str) -> DataFrame:
    """(symbol, branch, bar, facts as doubles) of one timeframe."""
    values = {"t": minutes("date"), "sign": F.col("extremum_sign"), "size": F.col("true_extremum_tf_minutes")}
    for n in (2, 3):
        values[f"p{n}_atr"] = F.col(f"p{n}_atr_aligned")
        for k in (PEAK, VALLEY):
            values[f"p{n}_{k}_near"] = F.col(f"near_p{n}_{k}")
            values[f"p{n}_{k}_last"] = minutes(f"p{n}_{k}_last_time")
            values[f"p{n}_{k}_price"] = F.col(f"p{n}_{k}_event_price")
            values[f"p{n}_{k}_time"] = minutes(f"p{n}_{k}_event_time")
    columns = [values.get(c, F.col(c)).cast("double").alias(c) for c in _FACTS]
    return facts.select("symbol", F.lit(tf).alias("branch"), "bar", *columns)


def dealt_facts(facts: DataFrame, tf: str, length: int, base: str, block_bars: int) -> DataFrame:
    """`facts` of a timeframe, each row in every block of anchors one of whose windows holds it."""
    width, base_width = TF_MINUTES[tf] * 60, TF_MINUTES[base] * 60
    # a bar is the last closed one of the anchors from its end less an anchor's width on, and stays in windows for `length` bars
    first = start_of_bar(F.col("bar") + 1, tf)
    blocks = [F.floor(bar_of(plus_seconds(first, s - base_width), base) / block_bars) for s in (0, length * width - base_width)]
    return facts.withColumn("_block", F.explode(F.sequence(*blocks)))


def features(x: dict[str, np.ndarray], tf: str, a_time: np.ndarray, a_close: np.ndarray) -> np.ndarray:
    """The features (anchors, bars, 15) of windows of facts (anchors, bars) as each anchor sees them; NaN is missing."""
    a_time, a_close = a_time[:, None], a_close[:, None]
    rungs = np.array([0.0, *[float(TF_MINUTES[r]) for r in RUNGS]])
    age = a_time - x["t"]
    seen = np.fmin(x["size"], rungs[np.searchsorted(rungs[1:], age, side="right")])
    weight = np.where(seen == 0, 0.0, x["sign"] * np.log1p(seen / TF_MINUTES[tf]) * np.fmin(1.0, divided(age, seen)))
    prices, times = [], []
    for n in (2, 3):
        width = float(TF_MINUTES[shifted(tf, n)])
        for k in (PEAK, VALLEY):
            near, last, event, since = (x[f"p{n}_{k}_{c}"] for c in ("near", "last", "price", "time"))
            fresh = since <= a_time - width
            nearer = fresh & (np.isnan(near) | (np.abs(x["close"] - event) < np.abs(x["close"] - near)))
            apart = x["close"] - np.where(nearer, event, near)
            prices.append(divided(np.where(np.isnan(apart), 0.0, apart), x[f"p{n}_atr"]))
            times.append(np.log1p(np.fmax(x["t"] - np.where(fresh, since, last), 0.0) / width))
    static = [x[c] for c in STATIC]
    return np.stack([divided(x["close"] - a_close, x["atr"]), *static, *prices, *times, weight], axis=-1).astype(np.float32)


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


def _nested(values: np.ndarray) -> pa.Array:
    """An Arrow array of the nested lists of (rows, …) floats."""
    out = pa.array(values.ravel(), pa.float32())
    for size in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size, dtype=np.int32)), out)
    return out


def _assembled(layout: Layout):
    """Arrow function for one block: its anchors and the facts of their windows become samples."""
    base = layout.branches[0]

    def assemble(anchors: pa.Table, facts: pa.Table) -> pa.Table:
        branch = facts["branch"].to_numpy(zero_copy_only=False)
        table = {c: facts[c].to_numpy().astype(np.float64) for c in _FACTS}
        a_time, a_close = (anchors[c].to_numpy().astype(np.float64) for c in ("_time", "_close"))
        good, found = np.ones(len(a_time), bool), {}
        rows, bars = {}, {}
        for tf in layout.branches:
            own = np.flatnonzero(branch == tf)
            bars[tf] = facts["bar"].to_numpy()[own]
            rows[tf] = own[np.argsort(bars[tf], kind="stable")]
            bars[tf] = np.sort(bars[tf])
            offset = WEEK_OFFSET_S // 60 if tf == "1W" else 0
            # the last bar of the branch that is closed when the anchor closes
            last = np.floor((a_time - (TF_MINUTES[tf] - TF_MINUTES[base]) - offset) / TF_MINUTES[tf]).astype(np.int64)
            start, end = (np.searchsorted(bars[tf], x) for x in (last - layout.windows[tf] + 1, last))
            whole = (end < len(bars[tf])) & (end - start == layout.windows[tf] - 1)
            whole[whole] &= bars[tf][end[whole]] == last[whole]
            good &= whole
            found[tf] = start
        for tf in layout.branches:
            chosen = np.flatnonzero(good)
            at = rows[tf][found[tf][chosen][:, None] + np.arange(layout.windows[tf])[None, :]]
            found[tf] = np.empty((len(good), layout.windows[tf], len(FEATURES)), np.float32)
            found[tf][chosen] = features({c: v[at] for c, v in table.items()}, tf, a_time[chosen], a_close[chosen])
            good[chosen] = ~np.isnan(found[tf][chosen]).any(axis=(1, 2))
        kept = pa.array(good)
        samples = {tf: found[tf][good] for tf in layout.branches}
        columns = {c: anchors[c].filter(kept) for c in ("symbol", "date")}
        columns |= {f"branch_{tf}": _nested(v) for tf, v in samples.items()}
        columns["auxiliary"] = _nested(np.concatenate([v[:, -1] for v in samples.values()], axis=1))
        columns |= {c: anchors[c].filter(kept).cast(pa.float32()) for c in ("mfe", "rer")}
        actions = np.stack([anchors[f"action_{a}"].to_numpy()[good] for a in ("long", "short", "none")], axis=1)
        columns["action"] = _nested(actions.astype(np.float32))
        return pa.table(columns)

    return assemble


def build_dataset(
    mt_candles: DataFrame, layout: Layout | None = None, anchors: Column | None = None, block_bars: int = 512
) -> DataFrame:
    """One row per anchor: `branch_<timeframe>` (window × 15 floats), `auxiliary` (the last bar of every branch),
    `mfe`, `rer` and `action` (one-hot). Anchors with any missing value are left out.

    `mt_candles` is a stacked gap-free table and is read once per branch. `anchors`, a condition on symbol and date, keeps
    some anchors only, before anything is joined to them. Anchors and the facts of all branches meet once, by symbol and block of
    `block_bars` anchors; a fact is one row there, however many windows hold it.
    """
    layout = layout or Layout()
    base = layout.branches[0]
    tables = {
        tf: staged(branch_table(mt_candles.where(F.col("timeframe") == tf), tf, layout.length(tf)))
        for tf in layout.branches
    }
    labels = excursion_labels(
        mt_candles.where(F.col("timeframe") == base), mt_candles.where(F.col("timeframe") == layout.floor_tf), base,
        layout.floor_tf, layout.horizon, layout.floor_length, layout.gate,
    ).where("mfe is not null and rer is not null")
    if anchors is not None:
        labels = labels.where(anchors)
    closes = tables[base].select("symbol", "bar", F.col("close").alias("_close"))
    asked = labels.join(closes, ["symbol", "bar"]).select(
        "symbol", "date", "mfe", "rer", *[f"action_{a}" for a in ("long", "short", "none")], "_close", minutes("date").alias("_time"),
        F.floor(F.col("bar") / block_bars).alias("_block"),
    )
    if anchors is not None:
        asked = staged(asked)
    facts = reduce(DataFrame.unionByName, [
        dealt_facts(branch_facts(add_pool_facts(tables[tf], tables, tf, layout), tf), tf, layout.windows[tf], base, block_bars)
        for tf in layout.branches
    ])
    if anchors is not None:
        facts = facts.join(asked.select("symbol", "_block").distinct(), ["symbol", "_block"], "left_semi")
    facts = facts.withColumnsRenamed({"symbol": "_symbol", "_block": "_of"})
    arrays = ", ".join(f"`branch_{tf}` array<array<float>>" for tf in layout.branches)
    met = asked.groupBy("symbol", "_block").cogroup(facts.groupBy("_symbol", "_of"))
    return met.applyInArrow(
        _assembled(layout), f"symbol string, date timestamp_ntz, {arrays}, auxiliary array<float>, mfe float, rer float, action array<float>")


def sample_rows(dataset: DataFrame, tf: str) -> DataFrame:
    """One branch of the samples in long form: a row per anchor and window position, a column per feature."""
    rows = dataset.select("symbol", "date", F.posexplode(f"branch_{tf}").alias("position", "_x"))
    return rows.select(
        "symbol", "date", "position", *[F.col("_x")[i].alias(name) for i, name in enumerate(FEATURES)]
    )


def evenly_spaced(dataset: DataFrame, n: int) -> DataFrame:
    """`n` samples of each symbol, the inner ones of `n` + 2 points spread evenly from its first to its last."""
    keys = dataset.select("symbol", "date")
    sizes = keys.groupBy("symbol").agg(F.count(F.lit(1)).alias("_size"))
    points = sizes.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"), "_size").select(
        "symbol", F.floor(F.col("_k") * (F.col("_size") - 1) / (n + 1)).alias("_n")
    ).distinct()
    chosen = numbered(keys, ("symbol",), name="_n").join(points, ["symbol", "_n"], "left_semi")
    return dataset.join(chosen.select("symbol", "date"), ["symbol", "date"], "left_semi")


def shape_violations(dataset: DataFrame, layout: Layout) -> DataFrame:
    """Counts of samples whose windows or label arrays have another size, or hold a missing value."""
    wrong = [
        F.count_if(
            (F.size(f"branch_{tf}") != n) | F.exists(f"branch_{tf}", lambda row: F.size(row) != len(FEATURES))
        ).alias(f"shape_{tf}")
        for tf, n in layout.windows.items()
    ]
    nulls = F.count_if(F.exists("auxiliary", lambda v: v.isNull() | F.isnan(v))).alias("missing_values")
    width = F.count_if(F.size("auxiliary") != len(FEATURES) * len(layout.windows)).alias("shape_auxiliary")
    one = F.count_if(F.aggregate("action", F.lit(0.0).cast("float"), lambda a, v: a + v) != 1).alias("not_one_action")
    return dataset.agg(F.count(F.lit(1)).alias("samples"), *wrong, width, nulls, one)
