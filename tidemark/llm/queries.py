"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, divergence, language, mixing, prefix_trie, quality, quality_rules, simhash, suffix_dedup,
    token_counts, topk, toxicity, warc,
)
from tidemark.llm.common import held_out, table
from tidemark.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ratings of 0 (poor), 1 (good prose, but toxic), 2 (good and clean).
GRADE = "quality * (2 - toxic)"
N_GRADES = 3


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), GRADE, N_GRADES)
    return quality.grades(docs, model)


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.scores(docs, model, least_score=0.3)


@query("op5_topk_search", topk.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer("byte_bpe_50k.tiktoken"), split_pattern()
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, packed=True)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks, pattern))


@query("op8_warc", warc.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, to = warc.archived(table(spark, sf_dir, "pages"))
    return warc.read(archives, to, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_quality_rules", quality_rules.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op10_source_mix", mixing.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop(mixing.ROW)


@query("op11_prefix_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_suffix_dedup", suffix_dedup.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", divergence.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
