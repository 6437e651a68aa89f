"""Moving averages over consecutive bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.operators.blocks import framed
from tidemark.session import staged

# Weights below this are under double precision next to the newest one.
_NEGLIGIBLE = 1e-17


def ewm_reach(alpha: float) -> int:
    """How many bars back an exponential weight still counts."""
    return math.ceil(math.log(_NEGLIGIBLE) / math.log(1 - alpha))


def ewm_block(alpha: float) -> int:
    """Block size for an exponential mean: a weight one block old is negligible, and weights stay in double range."""
    return 3 * ewm_reach(alpha)


def rma_alpha(length: int) -> float:
    return 1.0 / length


def ema_alpha(length: int) -> float:
    return 2.0 / (length + 1)


def sma(value: Column, w: WindowSpec, length: int) -> Column:
    """Plain mean of the last `length` rows, NULL until there are that many."""
    frame = w.rowsBetween(-(length - 1), 0)
    return F.when(F.count(value).over(frame) == length, F.avg(value).over(frame))


def rolling_std(value: Column, w: WindowSpec, length: int, population: bool = False) -> Column:
    frame = w.rowsBetween(-(length - 1), 0)
    std = F.stddev_pop if population else F.stddev_samp
    return F.when(F.count(value).over(frame) == length, std(value).over(frame))


def true_range(w: WindowSpec) -> Column:
    """Largest of high-low and the two distances to the previous close; NULL on the first bar."""
    prev = F.lag("close").over(w)
    return F.when(
        prev.isNotNull(),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def add_ewm(
    df: DataFrame, outputs: dict[str, tuple[Column, int]], alpha: float, keys=("symbol", "timeframe"), bar: str = "bar"
) -> DataFrame:
    """Exponential means with one weight: `outputs = {name: (value, min_periods)}`.

    Adjusted form: sum of x·d^age over sum of d^age, NULL values left out, NULL until there were `min_periods` values,
    however long ago. Inside a block both sums are running sums scaled by d^-position. What came before is carried as
    one row per block: the two sums of the last block with a value, folded with those of the block with a value before it
    (anything older is under double precision), and the count of all values. Only the ratio of the two sums matters
    where no newer value is there, so it outlives any gap.
    """
    size, d = ewm_block(alpha), 1 - alpha
    names = list(outputs)
    cut = staged(df.withColumns({f"_x_{n}": v for n, (v, _) in outputs.items()}).withColumn(
        "_block", F.floor(F.col(bar) / size).cast("long")))
    position = F.col(bar) - F.col("_block") * size
    faded = F.pow(F.lit(d), size - 1 - position)
    sums = cut.groupBy(*keys, "_block").agg(*[c for n in names for c in (
        F.sum(F.col(f"_x_{n}") * faded).alias(f"_num_{n}"),
        F.sum(F.when(F.col(f"_x_{n}").isNotNull(), faded)).alias(f"_den_{n}"),
        F.count(f"_x_{n}").alias(f"_n_{n}"),
    )])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def last_with_value(n: str) -> Column:
        state = F.struct("_block", F.col(f"_num_{n}").alias("num"), F.col(f"_den_{n}").alias("den"))
        return F.last(F.when(F.col(f"_n_{n}") > 0, state), ignorenulls=True).over(earlier)

    sums = sums.withColumns({f"_before_{n}": last_with_value(n) for n in names})
    folded = {}
    for n in names:
        fade = F.pow(F.lit(d), (F.col("_block") - F.col(f"_before_{n}._block")) * size)
        for part in ("num", "den"):
            folded[f"_{part}_{n}"] = F.col(f"_{part}_{n}") + F.coalesce(F.col(f"_before_{n}.{part}") * fade, F.lit(0.0))
    sums = sums.withColumns(folded)
    carried = sums.select(*keys, "_block", *[c for n in names for c in (
        last_with_value(n).alias(f"_in_{n}"), F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_many_{n}"))])
    upto = Window.partitionBy(*keys, "_block").orderBy(bar).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.pow(F.lit(1.0 / d), position)
    means = {}
    for n, (_, least) in outputs.items():
        x, held = F.col(f"_x_{n}"), F.col(f"_in_{n}")
        fade = F.pow(F.lit(d), (F.col("_block") - held["_block"] - 1) * size + 1)
        count = F.count(x).over(upto)
        total = F.sum(x * grown).over(upto) + F.coalesce(held["num"] * fade, F.lit(0.0))
        norm = F.sum(F.when(x.isNotNull(), grown)).over(upto) + F.coalesce(held["den"] * fade, F.lit(0.0))
        mean = F.when(count > 0, total / norm).otherwise(held["num"] / held["den"])
        means[n] = F.when(F.col(f"_many_{n}") + count >= least, mean)
    out = cut.join(carried, [*keys, "_block"]).withColumns(means)
    return out.select(*[c for c in df.columns if c not in means], *names)


def add_rma(df: DataFrame, column: str, length: int, out: str, **kw) -> DataFrame:
    """Wilder's mean of one column."""
    return add_ewm(df, {out: (F.col(column), length)}, rma_alpha(length), **kw)


def add_true_range(df: DataFrame, out: str, keys=("symbol", "timeframe"), bar: str = "bar") -> DataFrame:
    return framed(df, lambda rows, w: rows.withColumn(out, true_range(w)), before=1, keys=keys, bar=bar)


def add_atr(df: DataFrame, length: int, out: str = "atr", keys=("symbol", "timeframe"), bar: str = "bar") -> DataFrame:
    """ATR: Wilder's mean of the true range."""
    ranged = add_true_range(df, "_tr", keys, bar)
    return add_ewm(ranged, {out: (F.col("_tr"), length)}, rma_alpha(length), keys=keys, bar=bar).drop("_tr")
