import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators.similarity import compare_symbols, ks_pvalue


def limit(lam, terms=200_000):
    return 1.0 if lam == 0 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam) for k in range(1, terms))))


@pytest.mark.parametrize("d, n", [(0.0, 10), (1e-5, 10**6), (1e-3, 1000), (0.02, 3000), (0.044, 1000), (0.05, 800), (0.2, 500), (0.9, 400)])
def test_pvalues_are_those_of_the_whole_series(spark, d, n):
    got = spark.range(1).select(ks_pvalue(F.lit(d), F.lit(n), F.lit(n))).first()[0]
    assert got == pytest.approx(limit(d * d * n / 2), abs=1e-9)


def test_equal_samples_have_p_one(spark):
    rows = [(s, "1h", float(i % 17), float(i)) for s in ("a", "b") for i in range(120)]
    out = compare_symbols(spark.createDataFrame(rows, "symbol string, timeframe string, close double, volume double"), ["close", "volume"])
    assert [(r.ks_statistic, r.ks_pvalue) for r in out.collect()] == [(0.0, 1.0)] * 2
