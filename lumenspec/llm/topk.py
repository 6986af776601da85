"""Exact top-k search by the no-random-access method over sorted lists.

Every component of the vectors is a list of candidates sorted by value. A query reads each list from its good end, all
lists to the same depth, and knows for each candidate a lower bound (what was read, plus the worst that an unread
component can add) and an upper bound (plus what stands at the list's frontier). Candidates whose upper bound is below
the k-th lower bound are out; reading stops when few are left, and those get their final scores. Bounds are float64:
exact while no inner product can reach 2**53, beyond that apart by more than their rounding error.

Candidates lie in blocks of bounded size by a hash of their id, queries in larger blocks; each pair of blocks is one
task, which sorts its lists once, reads them for SLICE queries at a time, and gives its winners (k a query) to a ranking
window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

CANDIDATES, QUERIES, SLICE = 8192, 16384, 512


def finite(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


class Lists:
    """Each component's candidates by falling value: what a sequential reader finds at every depth."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        n, dims = vectors.shape
        self.vectors, self.ids, self.x = vectors, ids, vectors.astype(np.float64)
        order = np.argsort(-self.x, axis=0, kind="stable")
        self.rank = np.empty((n, dims), np.int32)
        self.rank[order, np.arange(dims)] = np.arange(n, dtype=np.int32)[:, None]
        self.values = np.take_along_axis(self.x, order, axis=0)
        self.largest = np.abs(self.x).max(axis=0)


def no_random_access(queries: np.ndarray, own: np.ndarray, read: Lists, k: int, first_depth: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its k best candidates; rows of the query's own id take no part."""
    vectors, ids, x, rank, lists = read.vectors, read.ids, read.x, read.rank, read.values
    n, dims = vectors.shape
    span = np.abs(queries.astype(np.float64)) @ read.largest  # no partial sum of a query is larger
    slack = np.where(span < 2.0**52, 0.0, span * (dims + 8) * 2.0**-51)  # twice the error of a bound's dims products and sums
    wide = span >= 2.0**62  # int64 might wrap: Python integers
    out: list = [None] * len(queries)
    active, depth = np.arange(len(queries)), min(n, first_depth)
    alive = np.arange(n)
    while len(active):
        up, down = np.maximum(queries[active], 0).astype(np.float64), np.minimum(queries[active], 0).astype(np.float64)
        xa, ra = x[alive], rank[alive]
        read_top, read_end = ra < depth, ra >= n - depth
        low = up @ np.where(read_top, xa, lists[-1]).T + down @ np.where(read_end, xa, lists[0]).T
        high = up @ np.where(read_top, xa, lists[depth - 1]).T + down @ np.where(read_end, xa, lists[n - depth]).T
        mine = own[active][:, None] == ids[alive][None, :]
        low[mine], high[mine] = -np.inf, -np.inf
        kth = np.partition(low, max(0, len(alive) - k), axis=1)[:, max(0, len(alive) - k)] if len(alive) > k else np.full(len(active), -np.inf)
        inside = (high >= (kth - slack[active])[:, None]) & ~mine
        left, still = inside.sum(1), []
        for i, q in enumerate(active):
            if left[i] <= 32 * k or depth >= n:
                at = alive[inside[i]]
                kind = object if wide[q] else np.int64
                score = vectors[at].astype(kind) @ queries[q].astype(kind)
                best = top_rows(score, ids[at], k)
                out[q] = ids[at][best], score[best].astype(np.int64)  # a score that is no long is an error
            else:
                still.append(i)
        alive = alive[inside[still].any(0)] if still else alive
        active, depth = active[still], min(n, depth * 2)
    return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(id long, vec array<long>) twice -> query_id, rank, id, score: each query's k highest integer inner products.

    Ties go to the smaller id; a row never answers a query of its own id; with fewer candidates all are returned; a
    query without candidates has no rows. Only vectors of one length meet. Repeated rows count as often as they occur:
    as candidates each is one, and a repeated query shares one ranking with its copies. Empty tables give an empty one.
    A score beyond 64 bits is an error.
    """
    n, q = (int(x.count()) for x in (candidates, queries))
    blocks, rounds = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))
    dealt = lambda d, own, others, mine, theirs: d.select(F.size("vec").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(own)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(theirs), "id", "vec")
    left, right = dealt(queries, rounds, blocks, "q", "c"), dealt(candidates, blocks, rounds, "c", "q")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        own, ids = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        wanted, lists = np.stack(a["vec"].to_numpy()), Lists(np.stack(b["vec"].to_numpy()), ids)
        found = [x for s in range(0, len(own), SLICE) for x in no_random_access(wanted[s : s + SLICE], own[s : s + SLICE], lists, k)]
        return pd.DataFrame({"query_id": np.repeat(own, [len(i) for i, _ in found]), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    keys = ["dims", "c", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    """A vector that takes part and has a component of 2^55 or more (2^63 times 1/256) is an error, as is a score beyond 64 bits; other edge rows: see exact_top_k."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite(F.col("embedding")) & F.col("vec_id").isNotNull())
    scaled = lambda x: F.when(F.abs(x) < 2.0**55, F.floor(F.lit(256.0) * x.cast("double"))).otherwise(F.raise_error(F.lit("256 times a component is no long")).cast("long"))
    rows = as_table(rows.select(F.col("vec_id").alias("id"), F.transform("embedding", scaled).alias("vec")))
    return exact_top_k(rows.where("id % 50 = 0"), rows).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
