"""First crossing: for each base row the first later (or earlier) target row whose value beats the base's level.

Two searches, neither of which forms pairs of rows:

1. Inside the block of the base row, by range maxima (numpy, one bounded block per group). The group also gets the
   maxima of the series' other blocks, one number per block (with `within_s` those of the blocks in reach), and looks there for
   the nearest block that holds a hit when its own does not.
2. Rows whose hit is in another block are sent there, by (block, own block), so a block that answers for much of a series does so in many
   groups. Only a block's running records can be first hits; they are sorted, so each answer is a binary search.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.clock import epoch_us, from_epoch_us
from tidemark.operators.blocks import spread
from tidemark.session import staged

# Comparators a caller may name: target value against base level. (sign that makes it "above", strictness)
COMPARATORS = {"gt": (1, True), "ge": (1, False), "lt": (-1, True), "le": (-1, False)}
BLOCK_BARS = 16_384


def first_beating(values: np.ndarray, start: np.ndarray, level: np.ndarray, strict: bool) -> np.ndarray:
    """Position of the first value at or after `start` that beats `level`; len(values) or more where none does.

    Range maxima for lengths 1, 2, 4, … let every search skip ahead by halving steps, all searches at once.
    """
    n = len(values)
    if n == 0:
        return start.astype(np.int64)
    maxima, width = [values], 1
    while width < n:
        wider = maxima[-1].copy()
        wider[:-width] = np.maximum(maxima[-1][:-width], maxima[-1][width:])
        maxima.append(wider)
        width *= 2
    at = start.astype(np.int64)
    for step in reversed(range(len(maxima))):
        best = maxima[step][np.minimum(at, n - 1)]
        hit = best > level if strict else best >= level
        at = np.where((at < n) & ~hit, at + (1 << step), at)
    return at


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.float64, copy=False)


def _block_search(directions: Sequence[str], strict: bool, same_time: bool):
    """Arrow function for one block: append to the base rows the hit inside the block, or the block that has it."""

    def search(base: pa.Table, other: pa.Table) -> pa.Table:
        index = other.filter(other["_index"].is_valid())["_index"].combine_chunks()
        rows = other.filter(other["_t"].is_valid())
        t, v = rows["_t"].to_numpy(), _floats(rows["_v"])
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        entries = index.flatten() if len(index) else None
        blocks = entries.field("k").to_numpy() if entries is not None else np.zeros(0, np.int64)
        maxima = entries.field("m").to_numpy() if entries is not None else np.zeros(0)
        asked, own = base["_t"].to_numpy(), base["_block"].to_numpy()
        level = _floats(base["_level"])
        valid = ~np.isnan(level)
        level = np.where(valid, level, np.inf)
        for d in directions:
            # to the left everything is mirrored: the arrays are reversed and times and numbers are negated
            turn = 1 if d == "right" else -1
            ts, vs = turn * t[::turn], v[::turn]
            ks, ms = turn * blocks[::turn], maxima[::turn]
            start = np.searchsorted(ts, turn * asked, side="left" if same_time else "right")
            at = first_beating(vs, start, level, strict)
            here = valid & (at < len(ts))
            hit_t, hit_v = np.zeros(len(asked), np.int64), np.zeros(len(asked))
            hit_t[here], hit_v[here] = turn * ts[at[here]], vs[at[here]]
            far = first_beating(ms, np.searchsorted(ks, turn * own, side="right"), level, strict)
            there = valid & ~here & (far < len(ks))
            block = own.copy()
            block[there] = turn * ks[far[there]]
            base = base.append_column(f"_{d}_t", pa.array(hit_t, mask=~here))
            base = base.append_column(f"_{d}_v", pa.array(hit_v, mask=~here))
            base = base.append_column(f"_{d}_k", pa.array(block))
            base = base.append_column(f"_{d}_far", pa.array(there))
        return base

    return search


def _far_search(strict: bool):
    """Arrow function for the rows of one block that another block answers: the first of its records beyond the level."""

    def search(asked: pa.Table, records: pa.Table) -> pa.Table:
        order = np.argsort(_floats(records["_v"]), kind="stable")
        t, v = records["_t"].to_numpy()[order], _floats(records["_v"])[order]
        at = np.searchsorted(v, _floats(asked["_level"]), side="right" if strict else "left")
        return pa.table({"_id": asked["_id"], "_d": asked["_d"], "_far_t": pa.array(t[at]), "_far_v": pa.array(v[at])})

    return search


def _index(b: DataFrame, maxima: DataFrame, by: list[str], reach: int | None) -> DataFrame:
    """The maxima that each block of base rows looks at: all of its series, or those at most `reach` blocks away."""
    blocks = b.select(*by, "_block").distinct()
    if reach is None:
        series = maxima.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_block").alias("k"), "m"))).alias("_index"))
        return blocks.join(series, by)
    near = maxima.select(*by, F.explode(F.sequence(F.col("_block") - reach, F.col("_block") + reach)).alias("_of"), F.struct(F.col("_block").alias("k"), "m").alias("_one"))
    lists = near.groupBy(*by, "_of").agg(F.sort_array(F.collect_list("_one")).alias("_index")).withColumnRenamed("_of", "_block")
    return blocks.join(lists, [*by, "_block"])


def first_crossing(
    base: DataFrame,
    target: DataFrame,
    level: str | Column,
    value: str | Column,
    comparator: str,
    bar_s: int,
    directions: Sequence[str] = ("right",),
    by: Sequence[str] = ("symbol",),
    base_time: str | Column = "date",
    target_time: str | Column = "date",
    same_time: bool = False,
    block_bars: int = BLOCK_BARS,
    base_parts: int = 1,
    within_s: int | None = None,
) -> DataFrame:
    """Add `<direction>_crossing_time` and `<direction>_crossing_value`, NULL where the level is never beaten.

    `bar_s` is the width of a target bar in seconds: a block covers `block_bars` of them, so it holds at most that
    many target rows of a series. `same_time` lets a target row at the base's own time count. `within_s` ends the search that many
    seconds from the base row. Where a block may have far more base rows than bars, `base_parts` deals them out to that many groups, each
    with the block's target rows. Base and target are read more than once; give tables or staged results.
    """
    by = list(by)
    up, strict = COMPARATORS[comparator]
    span = F.lit(bar_s * block_bars * 1_000_000)
    level_c = F.col(level) if isinstance(level, str) else level
    value_c = F.col(value) if isinstance(value, str) else value
    keys = [*by, "_block"]
    block = F.floor(F.col("_t") / span).cast("long").alias("_block")

    # rows without level or time get NaN as level, which nothing beats; those without time are spread over blocks
    asked = epoch_us(base_time)
    wanted = F.when(asked.isNotNull(), level_c.cast("double") * up)
    b = base.withColumns(
        {
            "_t": F.coalesce(asked, spread(base.columns) * span),
            "_level": F.coalesce(wanted, F.lit(float("nan"))),
        }
    ).select("*", block)
    t = (
        target.select(*by, epoch_us(target_time).alias("_t"), (value_c.cast("double") * up).alias("_v"))
        .where("_v is not null")
        .select("*", block)
    )
    reach = None if within_s is None else -(-within_s // (bar_s * block_bars)) + 1
    index = _index(b, t.groupBy(*keys).agg(F.max("_v").alias("m")), by, reach)
    other = t.unionByName(index, allowMissingColumns=True)
    groups = [*keys, "_part"]
    b = b.withColumn("_part", spread(base.columns, base_parts) if base_parts > 1 else F.lit(0).cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(base_parts - 1).cast("long"))
    other = other.withColumn("_part", F.explode(parts) if base_parts > 1 else F.lit(0).cast("long"))
    # base and target often come from one table; other column names keep the two sides apart
    other = other.select(*[F.col(k).alias(f"_target_{k}") for k in groups], "_t", "_v", "_index")
    kinds = {"t": T.LongType(), "v": T.DoubleType(), "k": T.LongType(), "far": T.BooleanType()}
    extra = [T.StructField(f"_{d}_{c}", kind) for d in directions for c, kind in kinds.items()]
    searched = (
        b.groupBy(*groups)
        .cogroup(other.groupBy(*[f"_target_{k}" for k in groups]))
        .applyInArrow(_block_search(directions, strict, same_time), schema=T.StructType([*b.schema.fields, *extra]))
    )
    out = staged(searched.withColumn("_id", F.monotonically_increasing_id()))

    # the rows whose hit is in another block, and that block's running records
    far = reduce(DataFrame.unionByName, [
        out.where(f"_{d}_far").select("_id", F.lit(d).alias("_d"), *by, F.col(f"_{d}_k").alias("_k"), F.col("_block").alias("_own"), "_level")
        for d in directions
    ])
    records = []
    for d in directions:
        toward = F.asc("_t") if d == "right" else F.desc("_t")
        before = Window.partitionBy(*keys).orderBy(toward).rowsBetween(Window.unboundedPreceding, -1)
        records.append(t.withColumn("_above", F.max("_v").over(before)).where("_above is null or _v > _above").withColumn("_d", F.lit(d)))
    answering = reduce(DataFrame.unionByName, records).select(*by, F.col("_block").alias("_k"), "_d", "_t", "_v")
    pairs = far.select(*by, "_k", "_d", "_own").distinct()
    answering = answering.join(pairs, [*by, "_k", "_d"])
    groups = [*by, "_k", "_d", "_own"]
    answering = answering.select(*[F.col(k).alias(f"_target_{k}") for k in groups], "_t", "_v")
    found = far.groupBy(*groups).cogroup(answering.groupBy(*[f"_target_{k}" for k in groups])).applyInArrow(
        _far_search(strict), "_id long, _d string, _far_t long, _far_v double")
    answers = found.groupBy("_id").agg(*[
        F.max(F.when(F.col("_d") == d, F.col(f"_far_{c}"))).alias(f"_{d}_far_{c}") for d in directions for c in ("t", "v")])
    out = out.join(answers, "_id", "left")
    for d in directions:
        time, hit = F.coalesce(f"_{d}_t", f"_{d}_far_t"), F.coalesce(f"_{d}_v", f"_{d}_far_v") * up
        if within_s is not None:
            near = F.abs(time - F.col("_t")) <= within_s * 1_000_000
            time, hit = F.when(near, time), F.when(near, hit)
        out = out.withColumns({f"{d}_crossing_time": from_epoch_us(time), f"{d}_crossing_value": hit})
    return out.select(*base.columns, *[f"{d}_crossing_{c}" for d in directions for c in ("time", "value")])
