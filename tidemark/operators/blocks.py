"""Window work in blocks of bounded size.

A series may hold a third of all rows, so no window here is partitioned by the series alone. Rows are cut
into blocks, and what a block needs from its neighbours is brought to it:

* frames of a known reach: the few rows next to a block are copied into it (`framed`);
* running values: one summary row per block is folded over the blocks and joined back (`fill`, `running`).

The summary of a series has one row per block, so folding it is small work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.clock import DAY_S, epoch_us

SERIES: tuple[str, ...] = ("symbol", "timeframe")
BLOCK_BARS = 4096
BLOCK_S = 30 * DAY_S


def framed(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = SERIES,
    bar: str = "bar",
    size: int = BLOCK_BARS,
) -> DataFrame:
    """Run `build(rows, w)` on blocks of `size` bars, each with `before`/`after` bars of its neighbours.

    `bar` numbers the rows of a series consecutively. `build` adds columns from frames over `w` that reach at
    most that far; the copied rows are dropped afterwards. One shuffle, whatever `build` computes.
    """
    first = F.floor((F.col(bar) - after) / size).cast("long")
    last = F.floor((F.col(bar) + before) / size).cast("long")
    rows = df.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_block").orderBy(bar)
    own = F.col("_block") == F.floor(F.col(bar) / size)
    return build(rows, w).where(own).drop("_block")


def time_block(date: str | Column, block_s: int = BLOCK_S) -> Column:
    return F.floor(epoch_us(date) / F.lit(block_s * 1_000_000)).cast("long")


def spread(columns: Sequence[str], over: int = 4096) -> Column:
    """A number that depends on the row only, to keep rows without a key from meeting in one task."""
    return F.pmod(F.xxhash64(*columns), F.lit(over))


def numbered(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("date",),
    name: str = "bar",
    block_s: int = BLOCK_S,
) -> DataFrame:
    """Number the rows of each series 0, 1, 2, … without sorting a whole series in one task.

    Rows are numbered inside time blocks; the counts of the earlier blocks are added. `order[0]` is the time.
    """
    cut = df.withColumn("_block", time_block(order[0], block_s))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_block", "_offset")
    )


def filled(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = SERIES,
    order: str = "date",
    forward: bool = True,
    block_s: int = BLOCK_S,
) -> DataFrame:
    """Forward (or backward) fill of `columns` along `order`."""
    t = epoch_us(order) if forward else -epoch_us(order)
    cut = df.withColumn("_t", t).withColumn("_block", F.floor(F.col("_t") / F.lit(block_s * 1_000_000)).cast("long"))
    lasts = cut.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_t"))).alias(f"_last_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *keys, "_block", *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*keys, "_block"], "left")
    out = out.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_in_{c}")) for c in columns}
    )
    return out.select(*df.columns)


# How a running value is folded: over the rows of a block, then over the blocks.
_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(
    df: DataFrame,
    outputs: dict[str, tuple[str, str | Column]],
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("date",),
    forward: bool = True,
    inclusive: bool = True,
    block_s: int = BLOCK_S,
    block: Column | None = None,
) -> DataFrame:
    """Prefix (or suffix) folds: `outputs = {name: ("sum"|"max"|"min", column)}`.

    `inclusive=False` leaves the row itself out. Blocks are cut by time, or by `block` if `order` is no time: a
    number that grows with `order[0]`.
    """
    cut = df.withColumn("_block", time_block(order[0], block_s) if block is None else block)
    values = {n: (kind, F.col(c) if isinstance(c, str) else c) for n, (kind, c) in outputs.items()}
    per_block = cut.groupBy(*keys, "_block").agg(*[_FOLDS[k][0](c).alias(f"_b_{n}") for n, (k, c) in values.items()])
    side = F.asc if forward else F.desc
    earlier = Window.partitionBy(*keys).orderBy(side("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "_block", *[_FOLDS[k][0](f"_b_{n}").over(earlier).alias(f"_in_{n}") for n, (k, _) in values.items()]
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*[side(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = cut.join(carried, [*keys, "_block"])
    return out.withColumns(
        {n: _FOLDS[k][1](_FOLDS[k][0](c).over(inside), F.col(f"_in_{n}")) for n, (k, c) in values.items()}
    ).drop("_block", *[f"_in_{n}" for n in values])
