"""Nearest value among the events an observer may already know."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.clock import epoch_us
from tidemark.operators.blocks import spread


def nearest_known(
    times: np.ndarray, prices: np.ndarray, cutoffs: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """For each query the price nearest to its value among the events up to its cutoff, NaN without any.

    Of equally near events the earliest counts. The events all queries know are searched in price order; the few
    that only some know are tried one by one, all queries at once.
    """
    order = np.argsort(times, kind="stable")
    times, prices = times[order], prices[order]
    known = np.searchsorted(times, cutoffs, side="right")
    best = np.full(len(values), np.nan)
    gap = np.full(len(values), np.inf)
    sure = int(known.min()) if len(known) else 0
    if sure:
        by_price = np.lexsort((np.arange(sure), prices[:sure]))
        ranked = prices[:sure][by_price]
        at = np.searchsorted(ranked, values, side="left")
        above = np.minimum(at, sure - 1)
        below = np.searchsorted(ranked, ranked[np.maximum(at - 1, 0)], side="left")
        gap_above = np.where(at < sure, np.abs(ranked[above] - values), np.inf)
        gap_below = np.where(at > 0, np.abs(values - ranked[below]), np.inf)
        earlier = by_price[below] < by_price[above]
        take_below = (gap_below < gap_above) | ((gap_below == gap_above) & earlier)
        best = np.where(take_below, ranked[below], ranked[above])
        gap = np.minimum(gap_above, gap_below)
    for event in range(sure, int(known.max()) if len(known) else 0):
        distance = np.abs(values - prices[event])
        better = (known > event) & (distance < gap)
        best[better], gap[better] = prices[event], distance[better]
    return best


def nearest_in_prefix(
    base: DataFrame,
    pool: DataFrame,
    value: str,
    cutoffs: dict[str, str | Column],
    bar_s: int,
    by: Sequence[str] = ("symbol",),
    block_bars: int = 16_384,
) -> DataFrame:
    """Add, per channel, the pool price nearest to `value` among the channel's events up to the row's cutoff time.

    `cutoffs = {channel: time}`; `pool` has `(*by, channel, time, price)` and is sparse: each event is sent to its
    own time block of the base and to the later ones of the series.
    """
    span = F.lit(bar_s * block_bars * 1_000_000)
    names = list(cutoffs)
    keys = [*by, "_block"]
    columns = base.columns
    b = base.withColumns(
        {**{f"_c_{n}": epoch_us(c) for n, c in cutoffs.items()}, "_value": F.col(value).cast("double")}
    )
    latest = F.greatest(*[F.col(f"_c_{n}") for n in names], F.lit(-(2**62)))
    b = b.withColumn("_block", F.when(latest > -(2**62), F.floor(latest / span).cast("long")).otherwise(spread(columns)))
    ends = b.groupBy(*by).agg(F.max("_block").alias("_last"))
    events = (
        pool.select(*by, "channel", epoch_us("time").alias("_t"), F.col("price").cast("double").alias("_p"))
        .withColumn("_first", F.floor(F.col("_t") / span).cast("long"))
        .join(ends, list(by))
        .where("_first <= _last")
        .withColumn("_block", F.explode(F.sequence("_first", "_last")))
    )
    events = events.select(*[F.col(k).alias(f"_pool_{k}") for k in keys], "channel", "_t", "_p")

    def search(rows: pa.Table, known: pa.Table) -> pa.Table:
        channel = np.asarray(known["channel"].to_pylist(), dtype=object)
        t, p = known["_t"].to_numpy(), known["_p"].to_numpy()
        values = rows["_value"].to_numpy().astype(np.float64)
        for n in names:
            mine = channel == n
            asked = rows[f"_c_{n}"]
            valid = asked.is_valid().to_numpy() & ~np.isnan(values)
            found = np.full(len(values), np.nan)
            if valid.any() and mine.any():
                found[valid] = nearest_known(t[mine], p[mine], asked.filter(asked.is_valid()).to_numpy()[
                    valid[asked.is_valid().to_numpy()]], values[valid])
            rows = rows.append_column(f"near_{n}", pa.array(found, mask=np.isnan(found)))
        return rows

    schema = T.StructType([*b.schema.fields, *[T.StructField(f"near_{n}", T.DoubleType()) for n in names]])
    out = b.groupBy(*keys).cogroup(events.groupBy(*[f"_pool_{k}" for k in keys])).applyInArrow(search, schema=schema)
    return out.select(*columns, *[f"near_{n}" for n in names])
