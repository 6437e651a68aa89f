"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out

#: Bytes of text in a sample; one text may take 1/1024 of them.
MAX_BYTES = 1 << 28


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, grade, text) of labelled documents outside the held-out quarter, the first by hash of the id: at most `max_rows`
    with at most `max_bytes` bytes of text together. Texts over `max_bytes` / 1024 are not taken, before anything is counted.

    Several labels of a document count as their mean, rounded down; a document that is there several times is taken once
    (its smallest text). The ids and grades, `max_rows` rows at most, are what is broadcast.
    """
    known = (
        labels.select("doc_id", grade.alias("grade"))
        .where("doc_id IS NOT NULL AND grade IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id").agg(F.floor(F.avg("grade")).cast("int").alias("grade"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes // 1024)
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    first = known.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # `max_rows` rows
    fits = first.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "grade")
    return texts.join(F.broadcast(fits), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
