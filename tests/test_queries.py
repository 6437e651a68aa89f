import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tidemark.queries import QUERIES
from tools.check import differences

CHECKED = [
    "candle_ladder", "atr", "relative_candle", "asof_backward", "first_crossing_right", "true_extremum", "top_strength",
    "cache_gaps", "symbol_distances", "profit_chain", "excursion_labels", "stream_closed_candles",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_registry():
    names, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(names)
    own = [n for n in names if not (re.fullmatch(r"op\d+_.*", n) or n == "pipeline")]
    assert set(own) == set(QUERIES) and len(own) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", ["atr", "candle_fill", "asof_backward", "first_crossing_right", "horizon_extremes", "ichimoku"])
def test_no_cross_join_and_no_window_over_a_whole_series(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
    specs = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    for spec in specs:
        keys = spec.split(" ASC")[0]
        # windows run inside a block; those over the blocks of a series order by the block itself
        assert "_block" in keys, spec


@pytest.mark.parametrize("name", ["candle_resample", "candle_ladder", "range_scan"])
def test_ticks_aggregate_by_hash(spark, name, monkeypatch):
    from tidemark.operators import resample

    monkeypatch.setattr(resample, "staged", lambda df: df)  # the whole plan in one
    assert "SortAggregate" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
