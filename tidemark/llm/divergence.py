"""Source divergence audit: how differently the sources of a language use its terms, from count-level bitmaps.

Terms are runs of letters (A-Z lowered) and of characters beyond ASCII. Terms in at least `least_docs` documents of a language are kept.
A group is (lang, source); each group, and each language, gives a kept term with count c the share
p = 1 + floor(10^9 (c + 5) / (N + 5 V)), with N its counts' sum and V the number of kept terms, in whole numbers.

Kept terms are numbered in blocks of at most about `BLOCK` terms, frequent ones first, and for every (group, count) a bitset tells the
terms with that count, as 64-bit words; words without a bit are not stored. Two groups' joint cell (i, j), the number of terms with count i here and j
there, is the population count of the AND of two bitsets, so the sum over terms of |p - q| is the sum over cells of n_ij |p_i - q_j|. Count 0
has no bitset: its cells follow by complement,

    sum = sum_ij n_ij (|p_i - q_j| - |p_0 - q_j| - |p_i - q_0| + |p_0 - q_0|) + sum_j n_j (|p_0 - q_j| - |p_0 - q_0|)
          + sum_i n_i (|p_i - q_0| - |p_0 - q_0|) + V |p_0 - q_0|     (i, j > 0; n_i, n_j: terms with the count in one group)

A task compares the groups of two tiles of `TILE` sources over one block, and block sums are added up, so neither a language with
many sources nor one with many terms meets in one task. Texts are counted in tasks that hand out their tallies when they grow.

Defined cases: NULL text, lang or source is empty; a group without kept terms counts 0 everywhere; a language without kept terms has value 0
for every pair; repeated rows count as documents each; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, staged

#: Terms in a block, about, and sources in a tile.
BLOCK, TILE = 1 << 13, 64
#: Tallies a task holds before it hands them out.
MOST_HELD = 400_000
#: Cells of two levels worked on at once.
AT_ONCE = 1 << 20
_TERM = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if c < 91 else c for c in range(256))


def tallies(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; a NULL term stands for the group itself. Rows of a key are to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(part.column(i) for i in range(3)), strict=True):
                    key = lang.as_py(), source.as_py()
                    tally = held.setdefault(key, {})
                    before = len(tally)
                    for term, n in Counter(text.as_py().encode().translate(_TERM).split()).items():
                        counts = tally.get(term)
                        if counts is None:
                            tally[term] = [n, 1]
                        else:
                            counts[0] += n
                            counts[1] += 1
                    size += len(tally) - before + 1
                    if size > MOST_HELD:
                        yield from given(held)
                        held, size = {}, 0
        yield from given(held)

    def given(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), tally in held.items():
            n = len(tally) + 1
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array([None, *(t.decode() for t in tally)], pa.string()),
                pa.array([0, *(c[0] for c in tally.values())], pa.int64()), pa.array([0, *(c[1] for c in tally.values())], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(n: Column) -> Column:
    """p of a count, from the columns total (N) and v (V); exact for every long."""
    wide = (n.cast("decimal(20,0)") + 5) * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = F.col("total").cast("decimal(20,0)") + 5 * F.col("v").cast("decimal(19,0)")
    return F.when(F.col("v") > 0, 1 + F.call_function("div", wide, below)).otherwise(1).cast("bigint")


def numbered(kept: DataFrame, block: int) -> DataFrame:
    """`kept` (lang, term, n, v) with block, word and bit of each term."""
    parts = F.ceil(F.col("v") / block).cast("bigint")
    order = Window.partitionBy("lang", "block").orderBy(F.desc("n"), "term")
    placed = kept.withColumn("block", F.pmod(F.xxhash64("term"), parts)).withColumn("number", F.row_number().over(order) - 1)
    return placed.select("lang", "term", "block", F.floor(F.col("number") / 64).cast("int").alias("word"), (F.col("number") % 64).alias("bit"))


def by_source(values: np.ndarray, sources: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Sums of `values` along `axis` for sources 0 .. n - 1; `sources` is sorted."""
    out = np.zeros((n, values.shape[1]) if axis == 0 else (values.shape[0], n), np.int64)
    if len(sources):
        starts = np.flatnonzero(np.concatenate([[True], sources[1:] != sources[:-1]]))
        sums = np.add.reduceat(values, starts, axis=axis)
        if axis == 0:
            out[sources[starts]] = sums
        else:
            out[:, sources[starts]] = sums
    return out


class Levels:
    """The count levels of a tile's sources over a block: parallel arrays of source, share, word and mask, by word and source."""

    def __init__(self, source: np.ndarray, p: np.ndarray, word: np.ndarray, mask: np.ndarray, zero: np.ndarray):
        order = np.lexsort((source, word))
        self.source, self.p, self.word, self.mask = source[order], p[order], word[order], mask[order].view(np.uint64)
        self.zero = zero  # the share of count 0, by source

    def one_sided(self, other: np.ndarray) -> np.ndarray:
        """sum_j n_j (|o - q_j| - |o - q_0|) for every o of `other` and every source of these levels."""
        order = np.argsort(self.source, kind="stable")
        source, p, size = self.source[order], self.p[order], np.bitwise_count(self.mask[order]).astype(np.int64)
        out, step = np.zeros((len(other), len(self.zero)), np.int64), max(1, AT_ONCE // max(1, len(other)))
        for at in range(0, len(p), step):
            s = source[at : at + step]
            more = np.abs(other[:, None] - p[None, at : at + step]) - np.abs(other[:, None] - self.zero[s][None, :])
            out += by_source(more * size[at : at + step], s, len(self.zero), 1)
        return out


def divergences(a: Levels, b: Levels, terms: int) -> np.ndarray:
    """sum |p - q| over a block of `terms` terms for every source of `a` (rows) and of `b` (columns)."""
    apart = np.abs(a.zero[:, None] - b.zero[None, :])
    out = terms * apart + b.one_sided(a.zero) + a.one_sided(b.zero).T
    for word in np.intersect1d(a.word, b.word):
        left = slice(*np.searchsorted(a.word, [word, word + 1]))
        right = slice(*np.searchsorted(b.word, [word, word + 1]))
        q, to, masks = b.p[right], b.source[right], b.mask[right]
        step = max(1, AT_ONCE // len(q))
        for at in range(left.start, left.stop, step):
            rows = slice(at, min(at + step, left.stop))
            p, of = a.p[rows], a.source[rows]
            joint = np.bitwise_count(a.mask[rows][:, None] & masks[None, :]).astype(np.int64)
            f = np.abs(p[:, None] - q[None, :]) - np.abs(a.zero[of][:, None] - q[None, :])
            f += apart[of[:, None], to[None, :]] - np.abs(p[:, None] - b.zero[to][None, :])
            out += by_source(by_source(joint * f, of, len(a.zero), 0), to, len(b.zero), 1)
    return out


def compared(cells: pa.Table, width: int) -> pa.Table:
    """(lang, a, b, value) of one cell: rows (lang, ta, tb, number, word, p, mask), word -1 for a group with its count 0 and the block's terms."""
    lang, ta, tb = (cells.column(c)[0].as_py() for c in ("lang", "ta", "tb"))
    source, word, p, mask = (cells.column(c).to_numpy().astype(np.int64) for c in ("number", "word", "p", "mask"))
    groups, sides = word < 0, []
    for tile in (ta, tb):
        mine = source // width == tile
        known = np.unique(source[groups & mine])
        zero = np.zeros(len(known), np.int64)
        zero[np.searchsorted(known, source[groups & mine])] = p[groups & mine]
        levels = ~groups & mine
        sides.append((known, Levels(np.searchsorted(known, source[levels]), p[levels], word[levels], mask[levels], zero)))
    (left, a), (right, b) = sides
    values = divergences(a, b, int(mask[groups][0]))
    x, y = np.repeat(left, len(right)), np.tile(right, len(left))
    other = x != y
    x, y, value = x[other], y[other], values.ravel()[other]
    if ta != tb:
        x, y, value = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([value, value])
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "a": x, "b": y, "value": value})


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: every other source by distance, and the terms most above the language's share."""
    counts = staged(tallies(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = staged(terms.where(F.col("docs") >= least_docs).drop("docs"))
    langs = staged(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total")))
    places = staged(numbered(terms.join(langs, "lang"), block))
    used = staged(counts.drop("docs").join(places, ["lang", "term"]))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    listed = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(listed.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
        F.coalesce("lang_total", F.lit(0)).alias("lang_total"), number.alias("number"), F.count("*").over(Window.partitionBy("lang")).alias("sources")))

    bits = used.groupBy("lang", "source", "n", "block", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    tiled = groups.withColumn("tiles", F.ceil(F.col("sources") / tile).cast("int"))
    levels = bits.join(tiled, ["lang", "source"]).select("lang", "block", "number", "tiles", "word", share(F.col("n")).alias("p"), "mask")
    blocks = places.groupBy("lang", "block").agg(F.count("*").alias("size"))
    bare = tiled.join(blocks, "lang", "left").select(
        "lang", F.coalesce("block", F.lit(0)).alias("block"), "number", "tiles", F.lit(-1).alias("word"), share(F.lit(0)).alias("p"),
        F.coalesce("size", F.lit(0)).alias("mask"))
    mine = F.floor(F.col("number") / tile).cast("int")
    dealt = levels.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "block", F.least(mine, "other").alias("ta"), F.greatest(mine, "other").alias("tb"), "number", "word", "p", "mask")
    cells = dealt.groupBy("lang", "block", "ta", "tb").applyInArrow(lambda t: compared(t, tile), "lang string, a bigint, b bigint, value bigint")
    pairs = cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("number").cast("bigint").alias("number"), "source")
    pairs = pairs.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    whole = terms.join(langs, "lang").withColumnRenamed("lang_total", "total").select("lang", "term", share(F.col("n")).alias("q"))
    own = used.select("lang", "source", "term", "n").join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n")).alias("p"))
    above = own.join(whole, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return ranked.unionByName(best)


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
    langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    sums AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
    p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v) AS p,
            1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * v) AS q
        FROM sums s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
        LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    items AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM items QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""
