import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F, types as T

from tidemark.functions.ladder import bar_of
from tidemark.operators.resample import candle_ladder
from tidemark.plans.labels import excursion_labels
from tidemark.streaming import live
from tidemark.streaming.labels import matured_labels

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, date timestamp, seq long, price double, volume double"


def _write(spark, folder, name, rows):
    data = [("s", START + timedelta(minutes=m), i, float(p), 1.0) for i, m, p in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_closed_candles_only_and_late_ticks_dropped(spark, tmp_path):
    source, out = tmp_path / "ticks", str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        live.run_to_end(live.closed_candles(stream, "5min", "5 minutes"), out)
        rows = spark.read.parquet(out).orderBy("date").collect()
        return [((r.date - START).seconds // 60, r.open, r.high, r.low, r.close, r.volume) for r in rows]

    _write(spark, source, "a", [(1, 0, 10), (2, 4, 12), (3, 6, 9), (4, 16, 7)])
    # the mark is at 11: the first two bars are closed, the bar of minute 15 is not
    assert run() == [(0, 10, 12, 10, 12, 2), (5, 9, 9, 9, 9, 1)]
    # a tick for a closed bar comes too late, one inside the mark is taken; nothing is given out twice
    _write(spark, source, "b", [(5, 3, 99), (6, 15, 8), (7, 30, 1)])
    assert run() == [(0, 10, 12, 10, 12, 2), (5, 9, 9, 9, 9, 1), (15, 8, 8, 7, 7, 2)]


def test_repeated_ticks_count_once(spark, tmp_path):
    _write(spark, tmp_path / "t", "a", [(1, 0, 10), (1, 0, 10), (2, 1, 11)])
    out = str(tmp_path / "out")
    live.run_to_end(live.unique_ticks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/t/*"), "5 minutes"), out)
    assert spark.read.parquet(out).count() == 2


def test_labels_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, price = {"s": [], "quiet": []}, 100.0
    for i in range(400):
        price += rng.uniform(-3, 3)
        for symbol in rows:
            if symbol == "s" or rng.random() < 0.6:  # a gap is filled with the close before it
                rows[symbol].append((symbol, START + timedelta(minutes=5 * i), price, price + rng.random(), price - rng.random(), price))
    rows["quiet"] = [r for r in rows["quiet"] if not 150 < (r[1] - START).seconds // 300 < 190]
    schema = "symbol string, date timestamp, open double, high double, low double, close double"
    out = str(tmp_path / "out")

    def run(part, lo, hi, extra=()):
        minutes = lambda r: (r[1] - START).total_seconds() / 60
        some = [r for s in rows.values() for r in s if lo <= minutes(r) < hi] + list(extra)
        rng.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "c" / part))
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/c/*")
        live.run_to_end(matured_labels(stream, "5min", "15min", "10 minutes", horizon=6, floor_length=5, gate=1.2), out)
        return spark.read.parquet(out)

    assert run("a", 0, 500).count() > 100
    again = [r for r in rows["s"] if 480 <= (r[1] - START).total_seconds() / 60 < 500]  # repeats change nothing
    run("b", 500, 510, again)
    run("c", 510, 1300)
    got = run("d", 1300, 2000).toPandas().sort_values(["symbol", "date"])
    whole = spark.createDataFrame([r for s in rows.values() for r in s], schema).withColumn("date", F.col("date").cast("timestamp_ntz"))
    mt = candle_ladder(whole.withColumns({"volume": F.lit(1.0), "timeframe": F.lit("5min"), "bar": bar_of("date", "5min")}), "5min", ["15min"])
    batch = excursion_labels(mt.where("timeframe = '5min'"), mt.where("timeframe = '15min'"), "5min", "15min", 6, 5, 1.2)
    batch = batch.select("symbol", "date", "mfe", "rer", "action").toPandas()
    # the mark is at minute 1985: bars that start at 1980 are settled
    seen = {s: max(r[1] for r in part if r[1] + timedelta(minutes=5) <= START + timedelta(minutes=1985)) for s, part in rows.items()}
    batch = batch[batch.date + timedelta(minutes=30) <= batch.symbol.map(seen)].sort_values(["symbol", "date"])
    assert len(got) == len(batch) > 700 and batch.mfe.isna().any()
    assert got.date.tolist() == batch.date.tolist() and got.action.tolist() == batch.action.tolist()
    for c in ("mfe", "rer"):
        assert np.allclose(got[c], batch[c], equal_nan=True)


def test_batches_are_appended_and_repeats_change_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.TimestampNTZType()), T.StructField("close", T.DoubleType())])
    table = str(tmp_path / "t")

    def rows():
        return sorted(((r.date - START).total_seconds() / 3600, r.close) for r in live.live_rows(spark, table, schema).collect())

    def put(name, data):
        data = [("s", START + timedelta(hours=h), float(c)) for h, c in data]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        live.into_table(stream, table, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return rows()

    def files():
        return {p.relative_to(table): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*")}

    assert put("a", [(0, 1), (1, 2), (30, 3)]) == [(0, 1), (1, 2), (30, 3)]
    before = files()
    merged = [(0, 1), (1, 5), (2, 6), (30, 3)]
    assert put("b", [(1, 5), (2, 6)]) == merged
    assert before.items() <= files().items()  # nothing stored was touched
    # a batch that is written again
    again = spark.createDataFrame([("s", START + timedelta(hours=h), float(c)) for h, c in [(1, 5), (2, 6)]], schema)
    again = again.withColumns({"window": bar_of("date", "1D"), "run": F.lit("b000000000001")})
    live._put(again, table, f"{table}.runs")
    assert rows() == merged
    # windows of several runs become one run; what comes later still wins
    assert live.compact_windows(spark, table, schema) == 1 and rows() == merged
    assert live.compact_windows(spark, table, schema) == 0
    assert put("c", [(2, 7), (31, 8)]) == [(0, 1), (1, 5), (2, 7), (30, 3), (31, 8)]
    assert live.compact_windows(spark, table, schema) == 2 and rows() == [(0, 1), (1, 5), (2, 7), (30, 3), (31, 8)]
