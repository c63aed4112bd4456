"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become integers, floor(1024 * x) per component. Queries and candidates are dealt to a grid of query blocks
and candidate blocks (both of bounded size), so nothing passes through the driver and no task holds a whole side.
In a cell every dimension of the candidates is one sorted list, read from the end that the sign of the query's
component favours, all lists to the same depth, deeper from round to round. After a round the read part of a
candidate's score is known; an unread component lies between the list's worst value and the one last read, which
gives a lower and an upper bound. A query stops when no candidate outside the best can qualify: neither one that was
seen in some list nor one that was seen in none. What is left then gets its final score, and the cells' results merge
by score and id.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part, as rows with a null
id; vectors of another length than the query's are not comparable and are left out; rows that repeat an id are one
candidate (the least vector); a query is never its own candidate; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm.common import table

K = 10
SCALE = 1024
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: shares of the lists that are read before the bounds are looked at
DEPTHS = (0.06, 0.15, 0.3, 0.6)
#: queries whose bounds are held at once
TOGETHER = 128


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def no_random_access(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                     depths=DEPTHS) -> list[tuple[int, int, int]]:
    """query_id, vec_id and score of each query's k best candidates (ties to the smaller id)."""
    n, dims = vectors.shape
    out: list[tuple[int, int, int]] = []
    if not n or not len(queries):
        return out
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    kind = np.float64 if largest < 2.0**52 else np.int64  # exact either way
    x = vectors.astype(kind)
    order = np.argsort(vectors, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    ascending = np.take_along_axis(x, order, axis=0)
    rounds = sorted({max(1, math.ceil(n * d)) for d in depths if math.ceil(n * d) < n})
    for begin in range(0, len(queries), TOGETHER):
        own, q = query_ids[begin : begin + TOGETHER], queries[begin : begin + TOGETHER].astype(kind)
        open_ = np.arange(len(own))
        left: list[np.ndarray | None] = [None] * len(own)
        for depth in rounds:
            up, down = np.maximum(q[open_], 0), np.minimum(q[open_], 0)
            high, low = place >= n - depth, place < depth  # read from the top, read from the bottom
            seen = up @ np.where(high, x, 0).T + down @ np.where(low, x, 0).T
            best_up, best_down = ascending[n - depth], ascending[depth - 1]
            worst_up, worst_down = ascending[0], ascending[n - 1]
            unread_up, unread_down = (~high).astype(kind), (~low).astype(kind)
            upper = seen + (up * best_up) @ unread_up.T + (down * best_down) @ unread_down.T
            lower = seen + (up * worst_up) @ unread_up.T + (down * worst_down) @ unread_down.T
            itself = own[open_][:, None] == ids[None, :]
            lower = np.where(itself, lower.min() - 1, lower)
            if n - 1 < k:
                break
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            alive = (upper >= kth[:, None]) & ~itself
            unseen = (up * best_up + down * best_down).sum(1)  # the most that a candidate in no list can reach
            done = (unseen < kth) & (alive.sum(1) <= max(4 * k, n // 50))
            for r in np.flatnonzero(done):
                left[open_[r]] = np.flatnonzero(alive[r])
            open_ = open_[~done]
            if not len(open_):
                break
        if len(open_):  # lists read to the end: every score is known
            full = q[open_] @ x.T
        for r in range(len(own)):
            at = left[r]
            if at is None:
                score = full[np.searchsorted(open_, r)]
                at = np.flatnonzero(ids != own[r])
                if len(at) > k:
                    least = np.partition(score[at], len(at) - k)[len(at) - k]
                    at = at[score[at] >= least]
                score = score[at]
            else:
                score = x[at] @ q[r]
            out += [(int(own[r]), int(ids[at[t]]), int(score[t])) for t in _top(ids[at], score, k)]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def _cell(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            by = dict(list(candidates.groupby(candidates["_v"].map(len))))
            for dims, own in queries.groupby(queries["_v"].map(len)):
                if dims in by:
                    found += no_random_access(by[dims]["_id"].to_numpy(), _matrix(by[dims]["_v"]), own["_id"].to_numpy(),
                                              _matrix(own["_v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def integer_vectors(rows: DataFrame, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """_id and _v (floor(1024 * x) as longs) of the rows that take part."""
    ok = F.col(name).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return rows.where(ok).select(F.col(name).alias("_id"), whole.alias("_v")).groupBy("_id").agg(F.min("_v").alias("_v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both sides have _id and _v as ``integer_vectors`` gives them."""
    n_queries, n_candidates = queries.count(), candidates.count()
    across, down = max(1, math.ceil(n_candidates / CANDIDATE_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        # all numbers of the other side's blocks, so that every pair of blocks meets in one cell
        return rows.select(F.pmod(F.xxhash64("_id"), F.lit(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), "_id", "_v")

    left = dealt(candidates, "_c", across, "_q", down).groupBy("_c", "_q")
    right = dealt(queries, "_q", down, "_c", across).groupBy("_c", "_q")
    found = left.cogroup(right).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op7_search(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("_id % 100 = 0"), vectors)
