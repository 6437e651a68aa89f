"""From raw documents to token ids: language, quality, near copies, mixing, encoding.

Each stage is (name, function of (spark, docs, sf_dir)) and works on everything its predecessor kept. Models are fitted on
the stage's own input. Only whole texts are compared, encoded or dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, language, mixing, quality, simhash
from tidemark.llm.common import staged, table
from tidemark.llm.queries import GRADE, N_GRADES, split_pattern, tokenizer
from tidemark.session import tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a known language stay."""
    return language.accepted(docs, language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of a good grade stay."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), GRADE, N_GRADES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.one_of_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.drawn_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every row."""
    return byte_bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("encoding", encode),
]

#: Classifiers and tokens are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
