"""How alike the value distributions of symbols are, per feature and over all features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.blocks import running
from tidemark.session import staged

# Histogram bins, least sample, and the weights of the similarity score.
BINS, LEAST_SAMPLE = 50, 50
WEIGHTS = {"js_divergence": 0.4, "cosine_similarity": 0.3, "wasserstein_distance": 0.2, "ks_statistic": 0.1}
BLOCKS = 256
#: Values of a block looked at in one go.
AT_ONCE = 4096
QUARTILES = (0.25, 0.5, 0.75)
STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(symbol, feature, x)` without NULL."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    return df.select("symbol", pairs.alias("_p")).select("symbol", "_p.*").where("x is not null")


def value_counts(values: DataFrame) -> DataFrame:
    """How often each value occurs: `(symbol, feature, x, c)`."""
    return values.groupBy("symbol", "feature", "x").agg(F.count(F.lit(1)).alias("c"))


def with_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add `block`, the part of the feature's pooled values a value lies in; every part holds a like share of them.

    The bounds are one small array per feature.
    """
    shares = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    bounds = counts.groupBy("feature").agg(F.percentile_approx("x", shares, 10 * BLOCKS).alias("_bounds"))
    at = F.size(F.filter("_bounds", lambda v: v <= F.col("x")))
    return rows.join(bounds, "feature").withColumn("block", at).drop("_bounds")


def describe(counts: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per symbol and feature, from value counts.

    A quartile lies between the values at two ranks; running counts over blocks of values find these, so the
    values of a symbol are never held in one place.
    """
    c = F.col("c")
    mean = counts.groupBy("symbol", "feature").agg(
        F.sum("c").alias("n"), (F.sum(F.col("x") * c) / F.sum("c")).alias("mean"), F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    rows = staged(with_blocks(counts, counts))
    ranked = running(rows, {"upto": ("sum", "c")}, keys=("symbol", "feature"), order=("x",), block=F.col("block"))
    placed = ranked.join(mean, ["symbol", "feature"])

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - c <= rank) & (rank < F.col("upto")), F.col("x")))

    gap = F.col("x") - F.col("mean")
    picked = [F.sum(gap * gap * c).alias("_squares")]
    for q in QUARTILES:
        rank = (F.col("n") - 1) * q
        picked += [value_at(F.floor(rank)).alias(f"_lo{q}"), value_at(F.ceil(rank)).alias(f"_hi{q}")]
    out = mean.join(placed.groupBy("symbol", "feature").agg(*picked), ["symbol", "feature"])
    quartiles = {}
    for q in QUARTILES:
        rank = (F.col("n") - 1) * q
        lo, hi = F.col(f"`_lo{q}`"), F.col(f"`_hi{q}`")
        quartiles[f"p{int(q * 100)}"] = lo + (hi - lo) * (rank - F.floor(rank))
    return out.withColumns({**quartiles, "std": F.sqrt(F.try_divide(F.col("_squares"), F.col("n") - 1))}).select(
        "symbol", "feature", "n", *STATS
    )


def symbol_pairs(stats: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """Each unordered pair of symbols with enough values, per feature."""
    big = stats.where(F.col("n") >= least)
    a = big.select("feature", F.col("symbol").alias("symbol_1"), *[F.col(s).alias(f"{s}_1") for s in ("n", *STATS)])
    b = big.select("feature", F.col("symbol").alias("symbol_2"), *[F.col(s).alias(f"{s}_2") for s in ("n", *STATS)])
    return a.join(b, "feature").where("symbol_1 < symbol_2")


def histogram(values: DataFrame, stats: DataFrame, bins: int = BINS) -> DataFrame:
    """Share of the values in each of `bins` equal parts of the symbol's own range, empty bins left out."""
    placed = values.join(stats.select("symbol", "feature", "n", "min", "max"), ["symbol", "feature"])
    at = F.floor(F.try_divide(F.col("x") - F.col("min"), F.col("max") - F.col("min")) * bins)
    return (
        placed.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy("symbol", "feature", "bin")
        .agg((F.count(F.lit(1)) / F.first("n")).alias("p"))
    )


def _histogram_distances(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    key = ["feature", "symbol_1", "symbol_2"]
    names = pairs.select(*key)
    first = names.join(bins.withColumnsRenamed({"symbol": "symbol_1", "p": "p1"}), ["feature", "symbol_1"])
    second = names.join(bins.withColumnsRenamed({"symbol": "symbol_2", "p": "p2"}), ["feature", "symbol_2"])
    both = (
        first.select(*key, "bin", "p1", F.lit(0.0).alias("p2"))
        .unionByName(second.select(*key, "bin", F.lit(0.0).alias("p1"), "p2"))
        .groupBy(*key, "bin")
        .agg(F.sum("p1").alias("p1"), F.sum("p2").alias("p2"))
    )
    middle = (F.col("p1") + F.col("p2")) / 2

    def entropy(p: str) -> Column:
        return F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p) / middle)).otherwise(0.0)

    return both.groupBy(*key).agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(entropy("p1") + entropy("p2")) / 2)).alias("js_divergence"),
        (F.sum(F.col("p1") * F.col("p2")) / F.sqrt(F.sum(F.col("p1") ** 2) * F.sum(F.col("p2") ** 2))).alias(
            "cosine_similarity"
        ),
    )


def _order_distances(stats: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Wasserstein-1 distance and Kolmogorov-Smirnov statistic of each pair of symbols from running value counts.

    All symbols of a feature meet block by block of values. A symbol comes with its own counts and with how many of its values lie before the
    block, so nothing is copied per pair; each block gives its part of every pair, and parts add up.
    """
    big = stats.where(F.col("n") >= least).select("symbol", "feature", "n")
    rows = staged(with_blocks(counts.join(big.drop("n"), ["symbol", "feature"], "left_semi"), counts))
    per_block = rows.groupBy("feature", "block").agg(F.min("x").alias("_first"))
    after = Window.partitionBy("feature").orderBy("block")
    blocks = per_block.select("feature", "block", F.lead("_first").over(after).alias("next"))
    sums = rows.groupBy("symbol", "feature", "block").agg(F.sum("c").alias("_c"))
    before = Window.partitionBy("symbol", "feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row per symbol and block, blocks being at most BLOCKS
    edges = big.join(blocks, "feature").join(sums, ["symbol", "feature", "block"], "left").select(
        F.col("symbol").alias("_s"), F.col("feature").alias("_f"), F.col("block").alias("_b"), "n", "next",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("before"))
    parts = rows.select("symbol", "feature", "block", "x", "c").groupBy("feature", "block").cogroup(edges.groupBy("_f", "_b")).applyInArrow(
        _block_distances, "feature string, symbol_1 string, symbol_2 string, w double, k double")
    return parts.groupBy("feature", "symbol_1", "symbol_2").agg(
        F.sum("w").alias("wasserstein_distance"), F.max("k").alias("ks_statistic"))


def _block_distances(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Parts of the distances of all pairs from one block of a feature's values."""
    order = np.argsort(np.array(edges["_s"].to_pylist(), dtype=object))
    names = [edges["_s"][int(i)].as_py() for i in order]
    place = {name: i for i, name in enumerate(names)}
    n = edges["n"].to_numpy().astype(float)[order]
    held = edges["before"].to_numpy().astype(float)[order]
    xs, at = np.unique(rows["x"].to_numpy(), return_inverse=True)
    own = np.array([place[s] for s in rows["symbol"].to_pylist()], np.int64)
    c, end = rows["c"].to_numpy().astype(float), edges["next"][0].as_py()
    steps = np.diff(np.append(xs, xs[-1] if end is None else end)) if len(xs) else np.zeros(0)
    by_value = np.argsort(at, kind="stable")
    own, at, c = own[by_value], at[by_value], c[by_value]
    w, k = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
    for first in range(0, len(xs), AT_ONCE):
        last = min(len(xs), first + AT_ONCE)
        some = slice(*np.searchsorted(at, [first, last]))
        fresh = np.zeros((len(names), last - first))
        np.add.at(fresh, (own[some], at[some] - first), c[some])
        upto = held[:, None] + np.cumsum(fresh, axis=1)
        held, share = upto[:, -1], upto / n[:, None]
        for i in range(len(names) - 1):
            gap = np.abs(share[i + 1 :] - share[i])
            w[i, i + 1 :] += gap @ steps[first:last]
            k[i, i + 1 :] = np.maximum(k[i, i + 1 :], gap.max(axis=1))
    a, b = np.triu_indices(len(names), 1)
    as_text = lambda which: pa.array([names[i] for i in which.tolist()], pa.string())
    return pa.table({
        "feature": pa.array([edges["_f"][0].as_py()] * len(a) if len(a) else [], pa.string()), "symbol_1": as_text(a), "symbol_2": as_text(b),
        "w": w[a, b], "k": k[a, b]})


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Limit distribution of the two-sample statistic, with λ = d²·n1·n2/(n1+n2).

    2·Σ(-1)^(k-1)·exp(-2k²λ) converges at once for large λ, its dual 1 - √(2π/λ)·Σ exp(-(2k-1)²π²/(8λ)) for small λ.
    Where they change over, at λ = 1, the fifth term of either is below 1e-20.
    """
    lam = (d * d * n1 * n2 / (n1 + n2)).cast("double")
    large, dual = F.lit(0.0), F.lit(0.0)
    for k in range(1, 6):
        large = large + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam)
        dual = dual + F.exp(-((2 * k - 1) ** 2) * math.pi**2 / 8 / lam)
    small = 1.0 - F.sqrt(2 * math.pi / lam) * dual
    value = F.when(lam >= 1, large).when(lam > 0, small).when(lam == 0, 1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def compare_symbols(df: DataFrame, features: Sequence[str], least: int = LEAST_SAMPLE) -> DataFrame:
    """All distances between each pair of symbols, per feature."""
    values = staged(long_form(df, features))
    counts = staged(value_counts(values))
    stats = staged(describe(counts))
    pairs = staged(symbol_pairs(stats, least))
    key = ["feature", "symbol_1", "symbol_2"]
    out = pairs.join(_histogram_distances(pairs, histogram(values, stats)), key).join(_order_distances(stats, counts, least), key)
    out = out.withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("n_1"), F.col("n_2")))
    diffs = {f"diff_{s}": F.abs(F.col(f"{s}_1") - F.col(f"{s}_2")) for s in STATS}
    return out.withColumns(diffs).select(
        *key, "js_divergence", "cosine_similarity", "wasserstein_distance", "ks_statistic", "ks_pvalue", *diffs
    )


def symbol_similarity(comparison: DataFrame) -> DataFrame:
    """One weighted score per pair of symbols."""
    grouped = staged(comparison.groupBy("symbol_1", "symbol_2").agg(*[F.avg(c).alias(c) for c in WEIGHTS]))
    # one number
    widest = grouped.agg(F.max("wasserstein_distance")).first()[0] or 0.0
    score = (
        (1 - F.col("js_divergence")) * WEIGHTS["js_divergence"]
        + F.col("cosine_similarity") * WEIGHTS["cosine_similarity"]
        + (1 - F.coalesce(F.try_divide(F.col("wasserstein_distance"), F.lit(widest)), F.lit(0.0))) * WEIGHTS["wasserstein_distance"]
        + (1 - F.col("ks_statistic")) * WEIGHTS["ks_statistic"]
    )
    return grouped.withColumn("similarity_score", score)


def top_and_bottom(df: DataFrame, by: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The `n` highest and the `n` lowest rows."""
    top = df.orderBy(F.desc(by), *tie).limit(n).withColumn("end", F.lit("most"))
    return top.unionByName(df.orderBy(F.asc(by), *tie).limit(n).withColumn("end", F.lit("least")))


def blend_weight(df: DataFrame, d: str, g: str, y: str) -> DataFrame:
    """Best share of forecast `d` in a blend with `g` against `y`, clipped to 0 … 1; a half if both are the same."""
    step = F.col(d) - F.col(g)
    out = df.agg(F.sum((F.col(y) - F.col(g)) * step).alias("_a"), F.sum(step * step).alias("_b"))
    return out.select(
        F.when(F.col("_b") < 1e-12, 0.5)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("_a", "_b"))))
        .alias("alpha")
    )


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least, greatest, mean and population deviation of each column, one row per column, in one pass."""
    row = df.agg(
        *[f(c).alias(f"{c}__{n}") for c in columns
          for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    )
    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{c}__{n}").alias(n) for n in ("min", "max", "mean", "std")])
                  for c in columns])
    )
    return row.select(stacked.alias("_s")).select("_s.*")
