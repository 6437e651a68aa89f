"""Streams over the given ticks, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.dataset import build_dataset
from tidemark.queries import query
from tidemark.queries.dataset_queries import LAYOUT, ROW_COLUMNS, SQL_DATASET, all_rows
from tidemark.queries.feature_queries import _labels_sql
from tidemark.queries.views import candles, r6, raw_candles, s6, sql_candles, stacked, table
from tidemark.session import shared_folder, staged
from tidemark.streaming import live
from tidemark.streaming.labels import matured_labels

KEY = ["symbol", "date"]


def _tick_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # event time of a stream is TIMESTAMP; results go back to TIMESTAMP_NTZ
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("date"), F.col("value").alias("price"),
        F.col("value").alias("volume"), F.col("event_id").alias("seq"),
    )


def _drained(spark, stream):
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    live.run_to_end(stream, path)
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("timestamp_ntz"))


SQL_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("stream_closed_candles", f"""WITH {sql_candles()}
SELECT symbol, date, open, high, low, close, {s6("volume", "volume")} FROM raw_1h WHERE date + INTERVAL 1 HOUR <= {SQL_CLOSED}""")
def stream_closed_candles(spark, sf):
    out = _drained(spark, live.closed_candles(_tick_stream(spark, sf), "1h", "2 hours"))
    return out.select(*KEY, "open", "high", "low", "close", r6("volume").alias("volume"))


@query("stream_unique_ticks", "SELECT event_type AS symbol, ts AS date, event_id AS seq FROM events")
def stream_unique_ticks(spark, sf):
    doubled = _tick_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(spark, live.unique_ticks(doubled, "2 hours")).select(*KEY, "seq")


def _matured_sql() -> str:
    """The batch labels of the anchors whose horizon had settled, quiet bars filled, when the stream ended."""
    body, final = _labels_sql(3).rsplit("\nSELECT", 1)
    return f"""{body}, mx AS (SELECT max(date) - INTERVAL 2 HOUR AS mark FROM raw_1h),
seen AS (SELECT symbol, max(date) AS seen FROM raw_1h, mx WHERE date + INTERVAL 1 HOUR <= mark GROUP BY symbol)
SELECT l.* FROM (SELECT{final}) l JOIN seen USING (symbol) WHERE date + INTERVAL 12 HOUR <= seen"""


@query("stream_matured_labels", _matured_sql())
def stream_matured_labels(spark, sf):
    closed = staged(raw_candles(spark, sf).withColumn("date", F.col("date").cast("timestamp")))
    stream = spark.readStream.schema(closed.schema).parquet(closed.inputFiles()[0].rsplit("/", 1)[0])
    out = _drained(spark, matured_labels(stream, "1h", "4h", "2 hours", horizon=12, floor_length=14, gate=1.5))
    return out.select(*KEY, r6("mfe").alias("mfe"), "action", r6("rer").alias("rer"))


@query("stream_into_windows", f"""WITH {sql_candles()}
SELECT symbol, date, close, {s6("volume", "volume")} FROM raw_1h WHERE date + INTERVAL 1 HOUR <= {SQL_CLOSED}""")
def stream_into_windows(spark, sf):
    place = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    stream = live.closed_candles(_tick_stream(spark, sf), "1h", "2 hours")
    stream = stream.withColumn("date", F.col("date").cast("timestamp_ntz"))
    live.into_table(stream, place, f"{place}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    live.compact_windows(spark, place, stream.schema)
    return live.live_rows(spark, place, stream.schema).select(*KEY, "close", r6("volume").alias("volume"))


@query("mature_rows", f"""WITH {sql_candles()}
SELECT symbol, date, close FROM c_1h WHERE date + INTERVAL 13 HOUR <= TIMESTAMP '2024-01-20 10:30:00'""")
def mature_rows(spark, sf):
    now = F.lit("2024-01-20 10:30:00").cast("timestamp_ntz")
    return live.mature_by(candles(spark, sf), "1h", 12, now).select(*KEY, "close")


@query("latest_closed_candles", f"""WITH {sql_candles()}
SELECT symbol, date, close FROM c_1h WHERE date BETWEEN TIMESTAMP '2024-01-20 03:00:00' AND TIMESTAMP '2024-01-20 09:00:00'""")
def latest_closed_candles(spark, sf):
    now = F.lit("2024-01-20 10:30:00").cast("timestamp_ntz")
    return live.latest_closed(candles(spark, sf), "1h", now, 7).select(*KEY, "close")


@query("now_sample", f"""{SQL_DATASET}
SELECT {ROW_COLUMNS} FROM allrows SEMI JOIN good USING (symbol, anchor) WHERE anchor = TIMESTAMP '2024-01-20 10:00:00'""")
def now_sample(spark, sf):
    now = F.lit("2024-01-20 10:00:00").cast("timestamp_ntz")
    return all_rows(build_dataset(staged(stacked(spark, sf)), LAYOUT, anchors=F.col("date") == now))
