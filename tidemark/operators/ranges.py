"""Interval joins without forming all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.clock import epoch_s
from tidemark.operators.blocks import filled, running
from tidemark.session import staged


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    time: str,
    start: str,
    end: str,
    bucket_s: int | Column,
    payload: Sequence[str],
    include_end: bool = True,
    how: str = "inner",
) -> DataFrame:
    """Pair each point with the intervals of its group that contain it, `start <= time <= end`.

    Time is cut into buckets about as long as an interval, so an interval falls in one or two buckets and a point
    meets only the intervals alive around it. `bucket_s` may be a column both sides have among `by`.
    """
    width = F.lit(bucket_s) if isinstance(bucket_s, int) else bucket_s
    first = F.floor(epoch_s(start) / width).cast("long")
    last = F.floor(epoch_s(end) / width).cast("long")
    spread = intervals.where(F.col(start) <= F.col(end)).select(
        *by, F.explode(F.sequence(first, last)).alias("_bucket"), F.col(start).alias("_start"), F.col(end).alias("_end"),
        F.struct(*payload).alias("_interval"),
    )
    keyed = points.withColumn("_bucket", F.floor(epoch_s(time) / width).cast("long"))
    until = F.col(time) <= F.col("_end") if include_end else F.col(time) < F.col("_end")
    left, right = keyed.alias("p"), spread.alias("i")
    same = F.col("p._bucket") == F.col("i._bucket")
    for k in by:
        same = same & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    joined = left.join(right, same & (F.col("_start") <= F.col(f"p.{time}")) & until, how)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"_interval.{c}") for c in payload])


def islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, touching: bool = False, block_s: int = 30 * 86_400
) -> DataFrame:
    """Number the groups of overlapping intervals: a new group starts where nothing before reaches the start.

    Adds `island` (the start of the group). `touching=True` also joins intervals that only meet.
    """
    reached = running(
        df, {"_reach": ("max", end)}, keys=keys, order=(start, end), inclusive=False, block_s=block_s
    )
    joined = F.col(start) <= F.col("_reach") if touching else F.col(start) < F.col("_reach")
    opened = reached.withColumn("island", F.when(F.coalesce(joined, F.lit(False)), F.lit(None)).otherwise(F.col(start)))
    return filled(opened.drop("_reach"), ["island"], keys=keys, order=start, block_s=block_s)


#: Cells of a value axis, see `best_covering`.
CELLS = 256


def best_covering(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    value: str,
    low: str,
    high: str,
    preference: Sequence[Column],
    payload: Sequence[str],
    cells: int = CELLS,
    prefix: str = "",
) -> DataFrame:
    """For each point the most preferred interval with `low < value < high`, NULL where there is none.

    The value axis of each group is cut into `cells` cells that hold about equally many values, points and interval ends together, so
    cells are narrow where values crowd, whatever their scale. An interval covers the cells between its ends whole: of those only the best
    per cell is kept. In the two cells of its ends it holds above its low or below its high: there the best so far
    in value order answers. Only an interval that lies inside one cell is compared with that cell's points.
    """
    rank = F.struct(*preference).alias("_rank")
    iv = intervals.select(
        *by, F.col(low).alias("_lo"), F.col(high).alias("_hi"), rank, F.struct(*payload).alias("_best")).where("_lo < _hi")
    # staged, so that the row numbers stay what they are when the rows are read again
    marked = staged(points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_v", F.col(value)))
    iv = staged(iv)
    values = marked.select(*by, "_v").unionByName(iv.select(*by, F.explode(F.array("_lo", "_hi")).alias("_v")))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    bounds = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", shares, 10 * cells)).alias("_bounds"))

    def cell(x: str) -> Column:
        return F.size(F.filter("_bounds", lambda b: b <= F.col(x))).cast("long")

    iv = iv.join(bounds, list(by)).withColumns({"_first": cell("_lo"), "_last": cell("_hi")}).drop("_bounds")
    p = marked.join(bounds, list(by), "left").withColumn("_cell", cell("_v")).drop("_bounds")
    choice = F.struct("_rank", "_best")

    inner = (
        iv.where("_last - _first > 1")
        .withColumn("_cell", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)))
        .groupBy(*by, "_cell")
        .agg(F.max(choice).alias("_whole"))
    )
    narrow = iv.where("_last = _first").select(*by, F.col("_first").alias("_cell"), "_lo", "_hi", choice.alias("_inside"))
    edges = iv.where("_last > _first")
    lefts = edges.select(*by, F.col("_first").alias("_cell"), F.col("_lo").alias("_v"), choice.alias("_left"))
    rights = edges.select(*by, F.col("_last").alias("_cell"), F.col("_hi").alias("_v"), choice.alias("_right"))
    rows = (
        p.unionByName(lefts, allowMissingColumns=True)
        .unionByName(rights, allowMissingColumns=True)
        .withColumn("_is_point", F.col("_id").isNotNull())
    )
    # strict on both sides: at equal value the points come before left ends upwards and before right ends downwards
    up = (
        Window.partitionBy(*by, "_cell")
        .orderBy("_v", F.desc("_is_point"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    down = (
        Window.partitionBy(*by, "_cell")
        .orderBy(F.desc("_v"), F.desc("_is_point"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = rows.withColumns({"_above": F.max("_left").over(up), "_below": F.max("_right").over(down)}).where("_is_point")
    found = found.drop("_left", "_right", "_is_point").join(inner, [*by, "_cell"], "left")
    near = (
        found.select(*by, "_cell", "_id", "_v")
        .join(narrow, [*by, "_cell"])
        .where("_lo < _v and _v < _hi")
        .groupBy("_id")
        .agg(F.max("_inside").alias("_inside"))
    )
    best = F.greatest("_above", "_below", "_whole", "_inside")
    out = found.join(near, "_id", "left").withColumn("_chosen", best)
    return out.select(*points.columns, *[F.col(f"_chosen._best.{c}").alias(prefix + c) for c in payload])


def overlap_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], bucket_s: int, payload: Sequence[str],
    start: str = "start", end: str = "end",
) -> DataFrame:
    """Pairs of intervals of one group that overlap (`a.start < b.end and a.end > b.start`), each pair once.

    Both sides are cut into time buckets; a pair that meets in several buckets is taken in the first it shares.
    """
    def cut(df: DataFrame) -> DataFrame:
        first = F.floor(epoch_s(start) / bucket_s).cast("long")
        last = F.floor(epoch_s(end) / bucket_s).cast("long")
        return df.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(F.col("_first"), last)))

    r = cut(right).select(
        *by, "_bucket", F.col("_first").alias("_r_first"), F.col(start).alias("_r_start"), F.col(end).alias("_r_end"),
        F.struct(*payload).alias("_right"),
    )
    met = cut(left).join(r, [*by, "_bucket"]).where(
        (F.col(start) < F.col("_r_end"))
        & (F.col(end) > F.col("_r_start"))
        & (F.col("_bucket") == F.greatest("_first", "_r_first"))
    )
    return met.select(*left.columns, *[F.col(f"_right.{c}").alias(f"other_{c}") for c in payload])
