"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors become integers, floor(scale * x). Rows are dealt into blocks of bounded size; every block of queries meets
every block of rows in a task of its own. There each dimension has a list of the block's rows sorted by that component. For
a query the lists are read from the end its component favours, some entries of every list at a time; rows met for the first
time get their exact score, and reading stops when the threshold - the score of a row that would stand at the current
place of every list - is below the k-th best score so far (not at it: an equal score may have a smaller id). The place at which a
row is first met is the smallest of its ranks in the lists, so it is known for all rows of a block in one pass.

Bounds are carried between blocks. The rows of the largest norms, about one block, are searched first; the k-th score found there is where
every other block starts from: a block whose lists' tops are below it is not read, the others stop earlier and hand out only rows that reach it. The
best of all blocks are merged per query.

Defined cases: a vector that is NULL, holds a NULL or a non-finite component, or has no id takes no part; a repeated id
counts once, with its smallest vector; components a shorter vector lacks are 0; equal scores go to the smaller id; fewer
than k rows give fewer results; an empty table gives an empty result. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Rows, and queries, that meet in one task.
ROWS = 8192
QUERIES = 2048
MOST_TASKS = 20_000
#: Entries read from every list in the first round; doubled each round.
FIRST = 64
#: The bound of a query without one.
NONE = -(1 << 62)


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v (array<bigint>) of the vectors that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    whole = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", finite))
    ints = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    return ints.groupBy("vec_id").agg(F.min("v").alias("v"))


class Lists:
    """Some rows' vectors and, for each dimension, their places in ascending order of the component."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids)
        self.ids, v = ids[order], v[order]
        # doubles add up exactly while no sum can leave their whole numbers
        most = np.abs(v).max(initial=0).astype(float) ** 2 * v.shape[1]
        self.v = v.astype(np.float64) if most < 2**52 else v
        places = np.argsort(v, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(v, places, axis=0))
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.low = np.empty((v.shape[1], len(ids)), kind)  # rank from the smallest component, by dimension
        np.put_along_axis(self.low, np.ascontiguousarray(places.T), np.arange(len(ids), dtype=kind)[None, :], axis=1)
        self.high = (len(ids) - 1 - self.low).astype(kind)  # rank from the largest one

    def top(self, q: np.ndarray, own: int, k: int, least: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows but `own`, best first; of rows below `least` some may be missing."""
        n, up, down = len(self.ids), q > 0, q < 0
        at, score, depth, step = np.zeros(0, np.int64), np.zeros(0, self.v.dtype), 0, FIRST
        if not (up.any() or down.any()):  # all scores are 0
            at = np.flatnonzero(self.ids != own)[:k]
            return self.ids[at], np.zeros(len(at), np.int64)
        weights = q.astype(self.v.dtype)
        met = np.minimum(self.high[up].min(axis=0, initial=n), self.low[down].min(axis=0, initial=n))
        while depth < n and self.threshold(q, up, down, depth) >= max(least, score.min() if len(at) == k else least):
            stop = min(n, depth + step)
            new = np.flatnonzero((met >= depth) & (met < stop))
            new = new[self.ids[new] != own]
            at = np.concatenate([at, new])
            score = np.concatenate([score, self.v[new] @ weights])
            if len(at) > k:
                if len(at) > 4 * k:  # all that reach the k-th score, then the smaller ids among equals
                    enough = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    at, score = at[enough], score[enough]
                best = np.lexsort((at, -score))[:k]  # places are in order of the id
                at, score = at[best], score[best]
            depth, step = stop, step * 2
        best = np.lexsort((at, -score))
        return self.ids[at[best]], score[best].astype(np.int64)

    def threshold(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """The score no row that is first met at `depth` or later can pass."""
        last = len(self.ids) - 1
        return int((q[up] * self.sorted[last - depth][up]).sum() + (q[down] * self.sorted[depth][down]).sum())


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def searched(asked: DataFrame, ints: DataFrame, k: int, row_blocks: int, query_blocks: int) -> DataFrame:
    """query_id, vec_id, score: of every block of `ints` the best rows for each of `asked` (vec_id, v, least)."""
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.select("vec_id", "v", "least", block(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    right = ints.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), block(row_blocks).alias("rb"))

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(rows):
            width = max(max(map(len, rows.v)), max(map(len, queries.v)))
            lists = Lists(rows.vec_id.to_numpy(), matrix(rows.v.tolist(), width))
            for own, q, least in zip(queries.vec_id.to_numpy(), matrix(queries.v.tolist(), width), queries.least.tolist(), strict=True):
                ids, scores = lists.top(q, own, k, least)
                enough = scores >= least
                found.append((np.full(enough.sum(), own), ids[enough], scores[enough]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    cells = min(row_blocks * query_blocks, MOST_TASKS)
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    left, right = left.repartition(cells, "qb", "rb"), right.repartition(cells, "qb", "rb")
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: str, k: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows with the highest scores for each row for which SQL `is_query` holds."""
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ints = staged(integers(vectors, scale).withColumn("norm", squares))
    asked = ints.where(is_query).withColumn("least", F.lit(NONE))
    n = ints.count()
    query_blocks = max(1, -(-asked.count() // queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if n <= rows:
        best = ranked(searched(asked, ints, k, 1, query_blocks))
    else:
        limit = ints.agg(F.percentile_approx("norm", 1 - rows / n, 10_000)).first()[0]
        large = ints.where(F.col("norm") >= limit)
        first = staged(ranked(searched(asked, large, k, max(1, -(-large.count() // rows)), query_blocks)))
        bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        bounded = asked.drop("least").join(bound, "vec_id", "left").fillna({"least": NONE})
        rest = searched(bounded, ints.where(F.col("norm") < limit), k, -(-n // rows), query_blocks)
        best = ranked(first.drop("rank").unionByName(rest))
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
    WITH ok AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
        FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""
