"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (lower-cased, words are runs of letters, each feature once): words, words' first 5 and first 7 bytes,
pairs of neighbours and pairs with one word between, hashed to 2^20 coordinates. Every coordinate has its own learning rate and an L1 threshold,
so that most weights are exactly 0; what is broadcast are the others, a few thousand numbers.

The model is fitted in one order on at most `max_rows` labelled texts of `max_bytes` bytes together (see `samples.labelled`). Texts of any
length are looked at whole.

Defined cases: a NULL or empty text has the bias alone; without any labelled row every score is 0.5; repeated rows each
give a row; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, through_arrow
from tidemark.llm.hashing import Tables, Words, bins, joined_words, mixed, runs
from tidemark.llm.samples import MAX_BYTES, labelled

BITS = 20


@dataclass
class Model:
    coordinates: np.ndarray  # of the weights that are not 0, ascending
    weights: np.ndarray
    bias: float


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def coordinates(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, coordinate) of each feature, by kind, repeats included."""
    texts, starts, ends = words.texts, words.starts, words.ends
    sums = words.sums(words.tables.values)
    h = words.span_hash(sums, starts, ends)
    found = [(texts, bins(h, BITS))]
    for salt, size in ((5, 5), (7, 7)):
        long = ends - starts > size
        stem = mixed(words.span_hash(sums, starts[long], starts[long] + size) + np.uint64(salt))
        found.append((texts[long], bins(stem, BITS)))
    for salt, gap in ((11, 1), (13, 2)):
        joint, at = words.pairs(h, gap, salt)
        found.append((at, bins(joint, BITS)))
    return found


def _sparse():
    tables = Tables()

    def compute(column: pa.Array) -> list[pa.Array]:
        found = [b""] * len(column)
        for rows, cut in runs(lowered(column), tables.space):
            keys = np.unique(np.concatenate(
                [(t << BITS) + a for words, _ in joined_words(cut, tables, tables.blank) for t, a in coordinates(words)]
            ))
            limits = np.searchsorted(keys, np.arange(len(rows) + 1) << BITS)
            for i, row in enumerate(rows):
                found[row] = (keys[limits[i] : limits[i + 1]] & ((1 << BITS) - 1)).astype("<i4").tobytes()
        return [pa.array(found, pa.binary())]

    return compute


def fit(
    docs: DataFrame, labels: DataFrame, toxic: str, max_rows: int = 12000, max_bytes: int = MAX_BYTES, rounds: int = 4,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1,
) -> Model:
    """Fit on labelled texts; `toxic` is SQL over `labels`, 0 or 1."""
    sample = labelled(docs, labels, F.expr(toxic), max_rows, max_bytes)
    got = through_arrow(sample, ["doc_id", "grade"], "coordinates binary", _sparse).toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    order = np.random.default_rng(3).permutation(len(got))  # ids may come in groups
    rows = [np.frombuffer(got[i]["coordinates"], "<i4") for i in order]
    return fitted(rows, [float(got[i]["grade"] > 0) for i in order], rounds, alpha, beta, l1, l2)


def fitted(rows, targets, rounds, alpha, beta, l1, l2) -> Model:
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, which no penalty shrinks

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        small = np.where(at < size, l1, 0.0)
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - small, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(rounds):
        for row, target in zip(rows, targets, strict=True):
            at = np.append(row, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - target
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    kept = np.flatnonzero(final[:size])
    return Model(kept.astype(np.int32), final[kept].astype(np.float32), float(final[size]))


def scores(docs: DataFrame, model: Model, least_score: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is at least `least_score`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, tables = shared.value, Tables()
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.coordinates] = model.weights

        def compute(column: pa.Array) -> list[pa.Array]:
            sums = np.full(len(column), model.bias)
            for rows, cut in runs(lowered(column), tables.space):
                hits = []
                for words, _ in joined_words(cut, tables, tables.blank):
                    for texts, at in coordinates(words):
                        some = dense[at] != 0
                        hits.append((texts[some] << BITS) + at[some])
                keys = np.unique(np.concatenate(hits))
                sums[rows] += np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], minlength=len(rows))
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            return [pa.array(score), pa.array((score >= least_score).astype(np.int32))]

        return compute

    scored = through_arrow(docs, ["doc_id"], "score double, predicted int", start)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
