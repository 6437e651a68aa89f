"""Forward-looking labels of a candle stream, each given out once its horizon is over.

State is kept per symbol and does not grow with the history: candles that may still get company (those the watermark has not
passed), the highs, lows and floors of the last `horizon` settled bars, the forming floor candle and the two sums of its ATR. A candle
settles when the watermark passes its end; the quiet bars between two settled candles are filled with the close before them, as in a
gap-free table. A timer on the earliest unsettled candle brings the state back when no candle of the symbol comes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.ladder import CANDLE_TIMEFRAMES, TF_MINUTES, WEEK_OFFSET_S
from tidemark.operators.smoothing import rma_alpha
from tidemark.plans.labels import ATR_FLOOR_LENGTH, EPS, HORIZON_BARS, OM_GATE

LABELS = "symbol string, date timestamp, mfe double, rer double, action string"
#: Anchors looked at in one go.
AT_ONCE = 8192


@dataclass(frozen=True)
class Rule:
    """What a label is made of, all times in seconds."""

    width: int
    offset: int
    horizon: int
    floor_width: int
    floor_offset: int
    floor_length: int
    gate: float


@dataclass
class Floor:
    """Wilder's mean of the true range of floor candles, from settled bars."""

    bin: int | None = None
    high: float = 0.0
    low: float = 0.0
    close: float = 0.0
    before: float | None = None
    num: float = 0.0
    den: float = 0.0
    count: int = 0
    atr: float = float("nan")

    def after(self, starts: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, rule: Rule) -> np.ndarray:
        """The ATR of the last floor candle that is over at the end of each bar, NaN without one."""
        out = np.empty(len(starts))
        bins = (starts - rule.floor_offset) // rule.floor_width
        heads = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else []
        for a, b in zip(heads, np.append(heads[1:], len(bins)), strict=True):
            if self.bin != bins[a]:
                self.bin, self.high, self.low = int(bins[a]), -np.inf, np.inf
            self.high, self.low, self.close = max(self.high, high[a:b].max()), min(self.low, low[a:b].min()), close[b - 1]
            out[a:b] = self.atr
            if starts[b - 1] + rule.width == (self.bin + 1) * rule.floor_width + rule.floor_offset:
                self.closed(rule)
                out[b - 1] = self.atr
        return out

    def closed(self, rule: Rule) -> None:
        if self.before is not None:
            ranged = max(self.high - self.low, abs(self.high - self.before), abs(self.low - self.before))
            fade = 1 - rma_alpha(rule.floor_length)
            self.num, self.den, self.count = self.num * fade + ranged, self.den * fade + 1, self.count + 1
            if self.count >= rule.floor_length:
                self.atr = self.num / self.den
        self.before = self.close


@dataclass
class Series:
    """The state of one symbol."""

    pending: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # bar start: high, low, close
    last: int | None = None  # start of the last settled bar
    close: float = 0.0
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: Floor = field(default_factory=Floor)

    def packed(self) -> bytes:
        """Plain values and arrays only, so that a newer version of the class can read them."""
        return pickle.dumps({**vars(self), "floor": vars(self.floor)})

    @classmethod
    def unpacked(cls, state: bytes) -> Series:
        values = pickle.loads(state)
        return cls(**{**values, "floor": Floor(**values["floor"])})

    def take(self, start: int, high: float, low: float, close: float) -> None:
        if self.last is None or start > self.last:
            self.pending.setdefault(start, (high, low, close))

    def settled(self, mark: float, rule: Rule) -> tuple[np.ndarray, ...]:
        """(starts, high, low, close) of the bars that are over by `mark`, quiet ones between them filled."""
        due = sorted(s for s in self.pending if s + rule.width <= mark)
        if not due:
            return (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        candles = np.array([self.pending.pop(s) for s in due])
        first = due[0] if self.last is None else self.last + rule.width
        starts = np.arange(first, due[-1] + 1, rule.width)
        real = np.searchsorted(due, starts, side="right") - 1  # the candle at or before each bar
        close = np.where(real >= 0, candles[np.maximum(real, 0), 2], self.close)
        own = (real >= 0) & (np.array(due)[np.maximum(real, 0)] == starts)
        high, low = (np.where(own, candles[np.maximum(real, 0), i], close) for i in (0, 1))
        self.last, self.close = due[-1], float(candles[-1, 2])
        return starts, high, low, close

    def labels(self, mark: float, rule: Rule) -> pd.DataFrame:
        """Labels of the anchors whose horizon is over by `mark`."""
        starts, high, low, close = self.settled(mark, rule)
        if not len(starts):
            return labelled([], rule)
        floors = np.concatenate([self.floors, self.floor.after(starts, high, low, close, rule)])
        highs, lows = np.concatenate([self.high, high]), np.concatenate([self.low, low])
        first = int(starts[-1]) - (len(highs) - 1) * rule.width
        parts = []
        for at in range(0, len(highs) - rule.horizon, AT_ONCE):
            n = min(AT_ONCE, len(highs) - rule.horizon - at)
            window = slice(at + 1, at + n + rule.horizon)
            parts.append((first + (at + np.arange(n)) * rule.width, highs[window], lows[window], floors[at : at + n]))
        self.high, self.low, self.floors = (x[-rule.horizon :] for x in (highs, lows, floors))
        return labelled(parts, rule)


def labelled(parts: list[tuple[np.ndarray, ...]], rule: Rule) -> pd.DataFrame:
    """Labels of anchors (start, highs and lows after it, floor), as `plans.labels.excursion_labels` gives them."""
    columns: list[list] = [[], [], [], []]
    for start, highs, lows, floor in parts:
        high = np.lib.stride_tricks.sliding_window_view(highs, rule.horizon)
        low = np.lib.stride_tricks.sliding_window_view(lows, rule.horizon)
        row = np.arange(len(start))
        best, worst = high.argmax(1), low.argmin(1)
        mfe = np.stack([high[row, best] - low[:, 0], high[:, 0] - low[row, worst]]).clip(0)
        adverse = np.stack([
            low[:, 0] - np.minimum.accumulate(low, 1)[row, best], np.maximum.accumulate(high, 1)[row, worst] - high[:, 0]]).clip(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mae = np.maximum(adverse, floor)  # NaN without a floor
            om = np.where(mae == 0, np.nan, mfe / mae)
            is_long = om[0] >= om[1]
            side = np.where(is_long, 0, 1)
            best_mfe, best_mae, best_om = mfe[side, row], mae[side, row], om[side, row]
            rer = np.clip(best_mae / (best_mfe - best_mae + EPS), 0, 1 / rule.gate)
        action = np.where(best_om > rule.gate, np.where(is_long, "long", "short"), "none")
        for column, values in zip(columns, (start, np.where(np.isnan(floor), np.nan, best_mfe), rer, action), strict=True):
            column.append(values)
    start, mfe, rer, action = (np.concatenate(c) if c else np.zeros(0) for c in columns)
    return pd.DataFrame({"date": pd.to_datetime(start.astype(np.int64), unit="s"), "mfe": mfe, "rer": rer, "action": action.astype(object)})


def matured_labels(
    candles: DataFrame, tf: str, floor_tf: str, late: str, horizon: int = HORIZON_BARS, floor_length: int = ATR_FLOOR_LENGTH,
    gate: float = OM_GATE,
) -> DataFrame:
    """symbol, date, mfe, rer, action of every anchor of a stream of closed candles (symbol, date, high, low, close).

    Equal to `excursion_labels` over the gap-free table of the candles that have settled; anchors without a whole horizon
    wait, those without a floor have NULL values. A repeated candle counts once. The first candle of a bar to come counts.
    """
    if not {tf, floor_tf} <= set(CANDLE_TIMEFRAMES):
        raise ValueError(f"timeframes of fixed width are needed: {CANDLE_TIMEFRAMES}")
    offset = lambda name: WEEK_OFFSET_S if name == "1W" else 0
    rule = Rule(TF_MINUTES[tf] * 60, offset(tf), horizon, TF_MINUTES[floor_tf] * 60, offset(floor_tf), floor_length, gate)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series.unpacked(state.get[0]) if state.exists else Series()
        for frame in frames:
            starts = (frame.start.to_numpy() - rule.offset) // rule.width * rule.width + rule.offset
            for row in zip(starts.tolist(), frame.high.tolist(), frame.low.tolist(), frame.close.tolist(), strict=True):
                series.take(*row)
        found = series.labels(state.getCurrentWatermarkMs() / 1000, rule)
        state.update((series.packed(),))
        if series.pending:
            state.setTimeoutTimestamp((min(series.pending) + rule.width) * 1000)
        if len(found):
            found.insert(0, "symbol", key[0])
            yield found

    rows = candles.withWatermark("date", late).select(
        "symbol", "date", F.unix_seconds("date").alias("start"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])
    return rows.groupBy("symbol").applyInPandasWithState(
        step, LABELS, "series binary", "append", GroupStateTimeout.EventTimeTimeout)
