import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_llm_queries import sql
from tidemark.llm.divergence import Levels, audit, divergences
from tools.check import differences


@pytest.mark.parametrize(("block", "tile"), [(1 << 13, 64), (70, 2), (3, 1)])
@pytest.mark.parametrize("where", ["sf", "edge"])
def test_equals_sql_in_blocks_and_tiles_of_any_size(spark, edge, where, block, tile):
    sf = SF if where == "sf" else edge
    got = audit(spark.read.parquet(f"{sf}/documents.parquet"), block=block, tile=tile).toPandas()
    assert differences(got, sql(sf, "op13_source_divergence")) == ""


def levels(counts, share):
    source, word, p, mask = [], [], [], []
    for s, row in enumerate(counts):
        for w in range(0, len(row), 64):
            for n in set(row[w : w + 64]) - {0}:
                bits = sum(1 << i for i, c in enumerate(row[w : w + 64]) if c == n)
                source.append(s), word.append(w // 64), p.append(share(s, n)), mask.append(bits - (1 << 64) if bits >> 63 else bits)
    zero = np.array([share(s, 0) for s in range(len(counts))], np.int64)
    as_array = lambda x, kind: np.array(x, kind)
    return Levels(as_array(source, np.int64), as_array(p, np.int64), as_array(word, np.int64), as_array(mask, np.int64), zero)


def test_cells_by_complement_equal_plain_sums():
    rng = np.random.default_rng(3)
    for terms in (1, 64, 65, 300):
        counts = rng.integers(0, 5, (4, terms)) * rng.integers(0, 2, (4, terms))
        counts[1] = 0
        share = lambda s, n: int(1 + 10**9 * (n + 5) // (100 + 17 * s + 5 * terms))
        rows = counts.tolist()
        expected = [[sum(abs(share(a, x) - share(b, y)) for x, y in zip(rows[a], rows[b], strict=True)) for b in range(4)] for a in range(4)]
        assert divergences(levels(rows, share), levels(rows, share), terms).tolist() == expected


def test_shares_stay_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.divergence import share

    rows = spark.createDataFrame([(2**62, 2**62 + 7, 3), (0, 0, 0), (10**18, 10**18, 10**9)], "n bigint, total bigint, v bigint")
    got = [r[0] for r in rows.select(share(F.col("n"))).collect()]
    assert got == [1 + 10**9 * (2**62 + 5) // (2**62 + 7 + 15), 1, 1 + 10**9 * (10**18 + 5) // (10**18 + 5 * 10**9)]
