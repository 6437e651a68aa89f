"""Language identification by nearest centroid.

A text is a vector of hashed letter 2- and 3-grams (of bytes, lower-cased, everything ASCII but letters read as a blank),
root term frequency times inverse document frequency, scaled to length 1. Each language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the largest cosine. A text whose best cosine is under
`least_similarity` sqrt(min(1, grams / `LONG`)) is too far from everything known and is rejected: a short text shares few grams with any
centroid, whatever its language.

Document frequencies come from every training row. Centroids are fitted on a sample by hash of at most about `max_rows`
rows, shared equally by the languages. The model is G languages x K centroids x 2^13 floats (128 kB a language).

Defined cases: a text that is NULL or has no letter is `und` with score 0 and rejected; without any training row every text
is; rows repeat as they come; equal cosines go to the smaller language; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered_by_arrow, held_out, through_arrow
from tidemark.llm.hashing import PIECE, Tables, mixed, runs

BITS = 13
BATCH = 64
UNKNOWN = "und"
#: Cosine under which a long text is rejected, and the grams from which a text is long. A cosine grows with the root of the number of grams.
LEAST, LONG = 0.12, 400


@dataclass
class Model:
    languages: list[str]  # of the centroids, in order
    centroids: np.ndarray  # (centroids, bins)
    idf: np.ndarray
    least_similarity: float


class Grams:
    """Gram counts of texts; one per task."""

    def __init__(self):
        self.space = Tables().space
        letters = np.arange(256, dtype=np.uint8)
        for code in range(128):
            if not chr(code).isalpha():
                letters[code] = 32
        self.letters = letters

    def counts(self, column: pa.Array):
        """(rows, counts as a dense matrix), some rows at a time."""
        import pyarrow.compute as pc

        lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        for start in range(0, len(lowered), BATCH):
            for rows, cut in runs(lowered.slice(start, BATCH), self.space, PIECE):
                total = np.zeros((len(rows), 1 << BITS), np.float32)
                front = np.zeros(0, np.uint8)  # the last bytes of the piece before
                for data, limits in cut:
                    if len(front):
                        data, limits = np.concatenate([front, data]), np.array([0, len(front) + len(data)])
                    total += self.of(data, limits, len(front))
                    front = data[-2:] if len(cut) > 1 else front
                yield start + rows, total

    def of(self, data: np.ndarray, limits: np.ndarray, old: int = 0) -> np.ndarray:
        """Counts of the grams that end behind the first `old` bytes."""
        n = len(limits) - 1
        read = self.letters[data].astype(np.uint64)
        text = np.repeat(np.arange(n), np.diff(limits))
        out = np.zeros(n << BITS, np.float32)
        for size in (2, 3):
            if len(read) < size:
                continue
            gram = np.full(len(read) - size + 1, size, np.uint64)
            blanks = np.zeros(len(gram), np.uint8)
            for k in range(size):
                part = read[k : k + len(gram)]
                gram = (gram << np.uint64(8)) | part
                blanks += part == 32
            whole = (text[: len(gram)] == text[size - 1 :]) & (blanks <= 1)
            whole[: max(0, old - size + 1)] = False
            if size == 3:  # a blank in the middle joins two words
                whole &= read[1 : 1 + len(gram)] != 32
            at = (text[: len(gram)][whole] << BITS) + (mixed(gram[whole]) >> np.uint64(64 - BITS)).astype(np.int64)
            out += np.bincount(at, minlength=len(out)).astype(np.float32)
        return out.reshape(n, 1 << BITS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(length, 1e-9)


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most `k` centroids of unit vectors: the farthest one is the next seed, then spherical k-means."""
    centre = v.mean(0)
    seeds = [v[int(np.argmax(v @ centre))]]
    for _ in range(min(k, len(v)) - 1):
        near = np.max(v @ np.stack(seeds).T, axis=1)
        if near.min() > 0.999:
            break
        seeds.append(v[int(np.argmin(near))])
    c = np.stack(seeds)
    for _ in range(rounds):
        at = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, max_rows: int = 4000, per_language: int = 3, least_similarity: float = LEAST) -> Model:
    rows = docs.select("doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())

    def document_frequencies(batches):
        grams, seen, total = Grams(), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for at, counts in grams.counts(batch.column(0)):
                seen += (counts > 0).sum(0)
                total += len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, 1 << BITS)), pa.array(np.concatenate([[total], seen]))], names=["gram", "texts"]
        )

    found = (
        rows.select("text").mapInArrow(document_frequencies, "gram bigint, texts bigint")
        .groupBy("gram").agg(F.sum("texts").alias("texts")).collect()  # one row per bin
    )
    frequency = np.zeros((1 << BITS) + 1)
    for r in found:
        frequency[r["gram"]] = r["texts"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])).astype(np.float32) + np.float32(0.1)

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = max_rows / max(1, len(sizes))
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, share / n))]) if sizes else None
    languages: list[str] = []
    centroids: list[np.ndarray] = []
    if sizes:
        draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * float(1 << 30)
        sample = through_arrow(rows.where(draw), ["lang"], "grams binary, counts binary", _packed).toArrow()
        names = np.array(sample.column("lang").to_pylist())
        grams, counts = sample.column("grams").to_pylist(), sample.column("counts").to_pylist()
        for lang in sorted(set(names)):
            v = np.zeros((int((names == lang).sum()), 1 << BITS), np.float32)
            mine = sorted(zip((grams[i] for i in np.flatnonzero(names == lang)),
                              (counts[i] for i in np.flatnonzero(names == lang)), strict=True))
            for i, (g, c) in enumerate(mine):
                v[i, np.frombuffer(g, np.int16)] = np.frombuffer(c, np.float32)
            v = vectors(v, idf)
            v = v[np.linalg.norm(v, axis=1) > 0]
            if len(v):
                c = clustered(v, per_language)
                centroids.append(c)
                languages += [str(lang)] * len(c)
    stacked = np.concatenate(centroids) if centroids else np.zeros((0, 1 << BITS), np.float32)
    return Model(languages, stacked.astype(np.float32), idf, least_similarity)


def _packed():
    grams = Grams()

    def compute(texts: pa.Array) -> list[pa.Array]:
        found, values = [], []
        for _, counts in grams.counts(texts):
            for row in counts:
                at = np.flatnonzero(row)
                found.append(at.astype(np.int16).tobytes())
                values.append(row[at].tobytes())
        return [pa.array(found, pa.binary()), pa.array(values, pa.binary())]

    return compute


def _predictor(model: Model):
    """Language, cosine and acceptance of each text of an Arrow column; None where there is no letter or no model."""

    def start():
        import regex

        letter = regex.compile(r"\p{L}")
        grams, weights = Grams(), model.centroids.T.copy()

        def compute(texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
            best, score, size = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            if model.languages:
                for rows, counts in grams.counts(texts):
                    cosines = vectors(counts, model.idf) @ weights
                    best[rows] = cosines.argmax(1)
                    score[rows] = np.clip(cosines.max(1), 0, 1)
                    size[rows] = counts.sum(1)
            known = np.array([bool(model.languages) and t is not None and letter.search(t) is not None for t in texts.to_pylist()], bool)
            score[~known] = 0
            near = known & (score >= model.least_similarity * np.sqrt(np.minimum(1, size / LONG)))
            return [model.languages[b] if k else None for b, k in zip(best, known, strict=True)], score, near

        return compute

    return start


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predictor = _predictor(shared.value)()

        def compute(texts: pa.Array) -> list[pa.Array]:
            found, score, near = predictor(texts)
            return [pa.array([UNKNOWN if f is None else f for f in found]), pa.array(score), pa.array(~near)]

        return compute

    return through_arrow(docs, ["doc_id"], "lang_pred string, score double, rejected boolean", start)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, whole, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predictor = _predictor(shared.value)()
        return lambda texts: pa.array(predictor(texts)[2])

    return filtered_by_arrow(docs, start)
