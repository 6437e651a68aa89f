"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = logistic(w . x - threshold_k), with one weight vector w for all grades and thresholds in ascending order.
x holds a text's hashed tokens as shares of its words: the word itself, its shape (class of its first byte, classes of its last
three), a repeat of the word before, and a run of three words that stood before in the text. The expected grade
(the sum of all tail probabilities) ranks documents; one tail probability selects them.

The model is fitted on at most `max_rows` labelled texts of `max_bytes` bytes together (see `samples.labelled`). It is 2^16 weights.
Texts of any length are looked at whole.

Defined cases: a NULL text is empty; an empty text has w . x = 0, so its score is what the thresholds give; without any
labelled row all weights are 0 and the thresholds are spread around 0; a grade nobody gave only moves its threshold;
repeated rows each give a row; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered_by_arrow, held_out, through_arrow
from tidemark.llm.hashing import Tables, Words, bins, joined_words, mixed, runs
from tidemark.llm.samples import MAX_BYTES, labelled

BITS = 16
#: Shares are small numbers; this brings them near 1.
SCALE = 10.0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; the k-th is for grade k + 1

    def tails(self, sums: np.ndarray) -> np.ndarray:
        """P(grade >= k + 1) for each text and k."""
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds[None, :], -40, 40)))


def tokens(words: Words, old: int = 0, runs_seen: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((text, bin) of each hashed token, by kind; hashes of the runs of three words so far).

    The first `old` words and `runs_seen` come from the piece before and only give what follows its neighbours.
    """
    tables, texts = words.tables, words.texts
    before = np.zeros(0, np.uint64) if runs_seen is None else runs_seen
    if not len(texts):
        return [], before
    h = words.span_hash(words.sums(tables.values), words.starts, words.ends)
    shapes = words.sums(tables.shapes)
    tail = words.span_hash(shapes, np.maximum(words.starts, words.ends - 3), words.ends)
    head = tables.shapes[words.data[words.starts]]
    found = [(texts[old:], bins(h[old:], BITS)), (texts[old:], bins(mixed(tail + head)[old:], BITS))]
    again = np.flatnonzero((h[1:] == h[:-1]) & (texts[1:] == texts[:-1]))
    again = again[again + 1 >= old]
    found.append((texts[1:][again], np.zeros(len(again), np.int64)))
    if len(h) > 2:
        three = mixed(mixed(h[:-2] + np.uint64(1)) + mixed(h[1:-1] + np.uint64(2)) * np.uint64(3) + h[2:])
        inside = (texts[2:] == texts[:-2]) & (np.arange(2, len(texts)) >= old)
        three = mixed(three[inside] + texts[2:][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        seen = np.ones(len(three), bool)
        seen[np.unique(three, return_index=True)[1]] = False
        if len(before):
            seen |= np.isin(three, before)
        found.append((texts[2:][inside][seen], np.ones(int(seen.sum()), np.int64)))
        before = np.union1d(before, three) if runs_seen is not None else before
    return found, before


class Scorer:
    """Sums of weights of texts; one per task."""

    def __init__(self, model: Model):
        self.model, self.tables = model, Tables()

    def tails(self, column: pa.Array) -> np.ndarray:
        sums, words = np.zeros(len(column)), np.zeros(len(column))
        for rows, cut in runs(column, self.tables.space):
            three = np.zeros(0, np.uint64) if len(cut) > 1 else None
            for w, old in joined_words(cut, self.tables):
                words[rows] += np.bincount(w.texts[old:], minlength=len(rows))
                found, three = tokens(w, old, three)
                for texts, at in found:
                    sums[rows] += np.bincount(texts, self.model.weights[at], minlength=len(rows))
        return self.model.tails(SCALE * sums / np.maximum(words, 1))


def _sparse():
    tables = Tables()

    def compute(texts: pa.Array) -> list[pa.Array]:
        found: list[tuple[bytes, bytes]] = [(b"", b"")] * len(texts)
        for rows, cut in runs(texts, tables.space):
            counts: dict[int, np.ndarray] = {}
            n_words = np.zeros(len(rows))
            three = np.zeros(0, np.uint64) if len(cut) > 1 else None
            for w, old in joined_words(cut, tables):
                n_words += np.bincount(w.texts[old:], minlength=len(rows))
                parts, three = tokens(w, old, three)
                keys = np.concatenate([(t << BITS) + a for t, a in parts]) if parts else np.zeros(0, np.int64)
                keys, n = np.unique(keys, return_counts=True)
                for i in range(len(rows)):
                    a, b = np.searchsorted(keys, [i << BITS, (i + 1) << BITS])
                    if a < b:
                        part = np.zeros(1 << BITS) if len(cut) > 1 else None
                        if part is None:
                            counts[i] = np.stack([keys[a:b] - (i << BITS), n[a:b]])
                        else:
                            if i in counts:
                                part[counts[i][0].astype(int)] = counts[i][1]
                            part[keys[a:b] - (i << BITS)] += n[a:b]
                            counts[i] = np.stack([np.flatnonzero(part), part[part > 0]])
            for i, row in enumerate(rows):
                if i in counts:
                    share = SCALE * counts[i][1] / max(1, n_words[i])
                    found[row] = (counts[i][0].astype("<i4").tobytes(), share.astype("<f4").tobytes())
        return [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())]

    return compute


def fit(
    docs: DataFrame, labels: DataFrame, grade: str, n_grades: int, max_rows: int = 8000, max_bytes: int = MAX_BYTES, rounds: int = 12,
    rate: float = 0.05, decay: float = 1e-4,
) -> Model:
    """Fit on labelled texts; `grade` is SQL over `labels`, 0 to n_grades - 1 (others are clipped)."""
    sample = labelled(docs, labels, F.least(F.greatest(F.expr(grade), F.lit(0)), F.lit(n_grades - 1)), max_rows, max_bytes)
    got = through_arrow(sample, ["doc_id", "grade"], "bins binary, shares binary", _sparse).toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    return _fitted(
        [np.frombuffer(r["bins"], "<i4") for r in got], [np.frombuffer(r["shares"], "<f4") for r in got],
        np.array([r["grade"] for r in got], np.int64), n_grades, rounds, rate, decay,
    )


def _fitted(rows, values, grades, n_grades, rounds, rate, decay) -> Model:
    """Adam on the likelihood of the grades. Gaps between thresholds are exponentials, so the order holds."""
    n_bins = 1 << BITS
    theta = np.zeros(n_bins + n_grades - 1)  # weights, first threshold, logs of the gaps
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    rng = np.random.default_rng(7)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([theta[n_bins : n_bins + 1], np.exp(theta[n_bins + 1 :])]))

    if not len(rows):
        theta[n_bins] = -np.exp(0.0) * (n_grades - 2) / 2
    for _ in range(rounds if len(rows) else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 128):
            part = order[start : start + 128]
            at, x = np.concatenate([rows[i] for i in part]), np.concatenate([values[i] for i in part])
            who = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            s = np.bincount(who, theta[at] * x, minlength=len(part))
            edges = np.concatenate([[-np.inf], thresholds(), [np.inf]])  # P(grade >= k) = logistic(s - edges[k])
            low, high = edges[grades[part]], edges[grades[part] + 1]
            up, down = 1 / (1 + np.exp(-np.clip(s - low, -30, 30))), 1 / (1 + np.exp(-np.clip(s - high, -30, 30)))
            p = np.maximum(up - down, 1e-9)
            d_low, d_high = up * (1 - up) / p, down * (1 - down) / p  # of the likelihood, by (s - low) and (s - high)
            d_low[np.isinf(low)], d_high[np.isinf(high)] = 0, 0
            by_s = -(d_low - d_high) / len(part)
            by_edge = np.zeros(n_grades + 1)
            np.add.at(by_edge, grades[part], d_low / len(part))
            np.add.at(by_edge, grades[part] + 1, -d_high / len(part))
            above = np.cumsum(by_edge[1:n_grades][::-1])[::-1]  # a gap moves all thresholds above it
            g = np.concatenate([
                np.bincount(at, by_s[who] * x, minlength=n_bins) + decay * theta[:n_bins],
                above[:1], above[1:] * np.exp(theta[n_bins + 1 :]),
            ])
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:n_bins].astype(np.float32), thresholds())


def grades(docs: DataFrame, model: Model, least_grade: int = 1, least_probability: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability of `least_grade` or better, kept (that probability is high)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            tails = scorer.tails(texts)
            tail = tails[:, least_grade - 1]
            return [pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least_probability)]

        return compute

    scored = through_arrow(docs, ["doc_id"], "expected_grade double, tail_probability double, kept boolean", start)
    return scored.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", "kept")


def accepted(docs: DataFrame, model: Model, least_grade: int = 1, least_probability: float = 0.5) -> DataFrame:
    """The rows of `docs`, whole, that `grades` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: pa.array(scorer.tails(texts)[:, least_grade - 1] >= least_probability)

    return filtered_by_arrow(docs, start)
