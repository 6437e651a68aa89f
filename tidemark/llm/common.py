"""What several operators share: the training split, staging, and passing Arrow batches through a function."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: A word, for Java's and for Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the rows no model learns from. A NULL id counts as the empty text, which is learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the one all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the table: lineage ends there and lost executors cost a re-read."""
    path = folder(df.sparkSession, "llm-staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def through_arrow(
    df: DataFrame, columns: list[str], added: str, fn: Callable[..., list[pa.Array]]
) -> DataFrame:
    """`columns` of `df` and the columns `added` (a DDL list), which `fn` computes from the Arrow column `text`.

    `fn` is made once per task by calling it without arguments, so that models are opened once per task.
    """
    kept = df.select(*columns, "text")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = fn()
        for batch in batches:
            for part in slices(batch):
                arrays = compute(part.column(len(columns)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *arrays], names=names)

    names = [*columns, *[c.strip().split(" ")[0].strip("`") for c in added.split(",")]]
    return kept.mapInArrow(run, schema)


def filtered_by_arrow(df: DataFrame, fn: Callable[..., pa.Array]) -> DataFrame:
    """The rows of `df`, with all their columns, for which `fn`, made once per task, gives true for the column `text`."""
    at = [c.lower() for c in df.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = fn()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(keep(part.column(at)))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes, so that what is computed from a part stays small. Long rows stay whole."""
    rows = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
