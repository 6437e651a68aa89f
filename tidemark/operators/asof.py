"""As-of joins: for each left row the latest (or next) right row of its series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.clock import epoch_us, from_epoch_us
from tidemark.functions.ladder import bar_of
from tidemark.operators.blocks import BLOCK_S, spread

# Dense look-ups: times per block to aim at, and how finely a block may be cut.
ROWS_PER_BLOCK = 1_000_000
MOST_PARTS = 1 << 20


def asof_channels(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    channels: dict[str, str | None],
    by: Sequence[str] = ("symbol",),
    left_time: str | Column = "date",
    right_time: str | Column = "date",
    direction: str = "backward",
    allow_equal: bool = True,
    tie: Sequence[str] = (),
    block_s: int = BLOCK_S,
    dense: bool = False,
) -> DataFrame:
    """As-of join that looks up several kinds of right rows in one pass.

    `channels = {prefix: condition}`: for each of them the nearest right row that meets the SQL condition (None:
    any) gives the columns `prefix + name` for every name in `payload`, NULL where there is none.

    Both sides meet in one sort per (series, time block); a block that starts without a right row gets the last
    one of the earlier blocks as an extra row. So a series is never sorted in one task, and gaps of any length
    are bridged. Right rows of one time are ordered by `tie`: the last wins backward, the first wins forward.

    A block of candles is bounded by its bars. Left rows without that bound, ticks say, are `dense`: their distinct
    times are looked up, in blocks that are cut finer where many times fall, and joined back by key and time.
    """
    if dense:
        moment = left_time if isinstance(left_time, Column) else F.col(left_time)
        timed = left.withColumn("_asked", epoch_us(moment))
        times = timed.where("_asked is not null").select(*by, "_asked").distinct()
        found = _asof(
            times, right, payload, channels, by, from_epoch_us("_asked"), right_time, direction, allow_equal, tie,
            block_s, True,
        )
        new = [f"{p}{c}" for p in channels for c in payload]
        # rows without a time keep apart from each other; they find nothing
        key = F.coalesce("_asked", -spread(left.columns, 1 << 20) - 1)
        out = timed.withColumn("_asked", key).join(found, [*by, "_asked"], "left")
        return out.select(*left.columns, *new)
    return _asof(
        left, right, payload, channels, by, left_time, right_time, direction, allow_equal, tie, block_s, False
    )


def _finer(rows: DataFrame, by: Sequence[str], width: Column) -> DataFrame:
    """Number the part of its block a time lies in; crowded blocks have more parts.

    Times are distinct microseconds, so a part holds no more of them than it is wide.
    """
    parts = F.ceil(F.col("_n") / F.lit(ROWS_PER_BLOCK)).cast("long")
    crowded = (
        rows.where("_side = 1")
        .groupBy(*by, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > ROWS_PER_BLOCK)
        .select(*by, "_block", F.least(parts, F.lit(MOST_PARTS)).alias("_parts"))
    )
    part = F.floor((F.col("_t") - F.col("_block") * width) / width * F.coalesce("_parts", F.lit(1)))
    return rows.join(crowded, [*by, "_block"], "left").withColumn(
        "_block", F.col("_block") * MOST_PARTS + F.least(part, F.coalesce("_parts", F.lit(1)) - 1).cast("long")
    ).drop("_parts")


def _asof(
    left: DataFrame, right: DataFrame, payload: Sequence[str], channels: dict[str, str | None], by: Sequence[str],
    left_time: str | Column, right_time: str | Column, direction: str, allow_equal: bool, tie: Sequence[str],
    block_s: int, split: bool,
) -> DataFrame:
    sign = 1 if direction == "backward" else -1
    width = F.lit(block_s * 1_000_000)
    names = list(channels)

    def keyed(df: DataFrame, time: str | Column) -> DataFrame:
        columns = df.columns
        df = df.withColumn("_t", epoch_us(time) * sign)
        # rows without a time sort first in whatever block they are sent to, and find nothing
        block = F.coalesce(F.floor(F.col("_t") / width).cast("long"), spread(columns))
        return df.withColumn("_block", block)

    def channel(i: int) -> Column:
        rule = channels[names[i]]
        row = F.struct(*payload)
        return (row if rule is None else F.when(F.expr(rule), row)).alias(f"_m{i}")

    span = range(len(names))
    tie_key = F.struct(*tie) if tie else F.lit(0)
    base = keyed(left, left_time).withColumn("_side", F.lit(1))
    match = keyed(right, right_time).where("_t is not null")
    match = match.select(*by, "_t", "_block", tie_key.alias("_tie"), *[channel(i) for i in span])

    def nearest(i: int) -> Column:
        """Per block and channel the row that is nearest to the blocks after it."""
        has = F.col(f"_m{i}").isNotNull()
        if sign == 1:
            return F.max_by(f"_m{i}", F.when(has, F.struct("_t", "_tie")))
        return F.min_by(f"_m{i}", F.when(has, F.struct(-F.col("_t"), F.col("_tie"))))

    rows = base.unionByName(match.withColumn("_side", F.lit(0 if allow_equal else 2)), allowMissingColumns=True)
    if split:
        rows = _finer(rows, by, width)
    ends = rows.groupBy(*by, "_block").agg(
        F.max(F.col("_side") == 1).alias("_wanted"), *[nearest(i).alias(f"_m{i}") for i in span]
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # the extra row has no time, so that it comes first in its block
    carried = (
        ends.withColumns({f"_m{i}": F.last(f"_m{i}", ignorenulls=True).over(earlier) for i in span})
        .where("_wanted")
        .withColumn("_side", F.lit(-1))
        .drop("_wanted")
    )
    order = F.when(F.col("_side") == -1, 1).when(F.col("_t").isNull(), 0).otherwise(2)
    w = (
        Window.partitionBy(*by, "_block")
        .orderBy(order, "_t", "_side", F.asc("_tie") if sign == 1 else F.desc("_tie"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = rows.unionByName(carried, allowMissingColumns=True).withColumns(
        {f"_f{i}": F.last(f"_m{i}", ignorenulls=True).over(w) for i in span}
    )
    return found.where("_side = 1").select(
        *left.columns, *[F.col(f"_f{i}.{c}").alias(names[i] + c) for i in span for c in payload]
    )


def asof_join(left: DataFrame, right: DataFrame, payload: Sequence[str], prefix: str = "", **options) -> DataFrame:
    """One-channel form: backward takes the latest right row at or before the left time, forward the first at or
    after it, `allow_equal=False` makes either strict."""
    return asof_channels(left, right, payload, {prefix: None}, **options)


def bar_join(
    left: DataFrame, right: DataFrame, payload: Sequence[str], tf: str, prefix: str = "", by: Sequence[str] = ("symbol",),
    left_time: str | Column = "date", direction: str = "backward", allow_equal: bool = True,
) -> DataFrame:
    """As-of join with gap-free bars of one timeframe: the bar's number says which one it is, so it is an equi join.

    `right` has `bar` and no gap between its first and its last bar of a series; those two, one row a series, keep times beyond them on
    the last (or first) bar. Any number of left rows may fall into a bar.
    """
    time = epoch_us(left_time)
    just_before = F.timestamp_micros(time - 1).cast("timestamp_ntz")
    backward = direction == "backward"
    # backward the last bar that starts by then (strict: before then), forward the one after the last that starts before then (by then)
    last_by = bar_of(from_epoch_us(time) if allow_equal == backward else just_before, tf)
    at = F.least(last_by, F.col("_last")) if backward else F.greatest(last_by + 1, F.col("_first"))
    ends = right.groupBy(*by).agg(F.min("bar").alias("_first"), F.max("bar").alias("_last"))
    bars = right.select(*by, F.col("bar").alias("_at"), *[F.col(c).alias(prefix + c) for c in payload])
    placed = left.join(ends, list(by), "left").withColumn("_at", F.when(time.isNotNull(), at))
    return placed.join(bars, [*by, "_at"], "left").select(*left.columns, *[prefix + c for c in payload])
