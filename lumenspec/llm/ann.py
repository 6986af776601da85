"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam.

Shards are dealt by a hash of the id and hold a bounded number of vectors, more in larger tables, as a search opens few of
a graph's nodes; equal vectors of a shard are one node. Vectors of one graph have largest components within a factor of
2^BAND and are scaled by a power of two, so any finite values do, side by side; scores are those of the original vectors. A graph grows in batches: greedy searches from the medoid over the graph so far propose neighbours of each new node, and
robust pruning keeps an edge only if no kept neighbour is closer to its end by the factor alpha, so edges stay diverse.
Every query searches every shard; the shards' answers meet in a ranking window. The index is a table of nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table
from .topk import finite

LEAST_SHARD, MOST_SHARD, SHARDS = 4096, 1 << 18, 64  # a shard's vectors; shards that smaller tables are cut into
QUERIES = 8192
BAND = 8  # powers of two that the largest components of a graph's vectors span
FAR = 2.0**40  # a graph's components are at most 1; to a query farther off than this, all its nodes are alike


def distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of the queries q [b, d] to the nodes at [b, m]; -1 is no node."""
    d = x[at] - q[:, None, :]
    return np.where(at < 0, np.inf, np.einsum("bmd,bmd->bm", d, d))


def scaled(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as float32 over one power of two that leaves all components of x at most 1, and those of the others at most FAR."""
    shift = -int(np.frexp(float(np.abs(x).max()) if x.size else 0.0)[1])
    with np.errstate(over="ignore"):
        return [np.clip(np.ldexp(a.astype(np.float64), shift), -FAR, FAR).astype(np.float32) for a in (x, *others)]


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of all queries in step: (nodes, squared distances), each query's `beam` best, nearest first, padded with -1."""
    b = len(q)
    nodes = np.full((b, beam), -1, np.int32)
    nodes[:, 0] = start
    near = distances(x, nodes, q)
    done = nodes < 0
    while True:
        open_ = np.where(done, np.inf, near)
        pick = open_.argmin(1)
        rows = np.flatnonzero(np.isfinite(open_[np.arange(b), pick]))
        if not len(rows):
            return nodes, near
        done[rows, pick[rows]] = True
        new = edges[nodes[rows, pick[rows]]]
        new = np.where((new[:, :, None] == nodes[rows][:, None, :]).any(2), -1, new)
        all_nodes = np.concatenate([nodes[rows], new], 1)
        all_near = np.concatenate([near[rows], distances(x, new, q[rows])], 1)
        all_done = np.concatenate([done[rows], new < 0], 1)
        best = np.argpartition(all_near, beam - 1, 1)[:, :beam]
        best = np.take_along_axis(best, np.take_along_axis(all_near, best, 1).argsort(1, kind="stable"), 1)
        nodes[rows], near[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (all_nodes, all_near, all_done))


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of `own` at most `degree` of its candidates: the nearest first, without those that a kept one is alpha times closer to."""
    own_x = x[own]
    near = distances(x, np.where(candidates == own[:, None], -1, candidates), own_x)
    order = near.argsort(1, kind="stable")
    cand, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    again = np.zeros_like(near, bool)
    by_node = np.argsort(cand, 1, kind="stable")
    s = np.take_along_axis(cand, by_node, 1)
    np.put_along_axis(again, by_node[:, 1:], s[:, 1:] == s[:, :-1], 1)
    near[again] = np.inf
    vec = x[cand]
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        pick = near.argmin(1)
        some = np.isfinite(near[rows, pick])
        if not some.any():
            break
        out[some, k] = cand[rows, pick][some]
        between = vec - vec[rows, pick][:, None, :]
        near[(alpha * alpha * np.einsum("bmd,bmd->bm", between, between) <= near) & some[:, None]] = np.inf
        near[rows, pick] = np.inf
    return out


def build(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 256) -> tuple[int, np.ndarray]:
    """(start, edges [n, degree], -1 for none) over distinct vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        new = order[at : at + max(1, min(batch, at))].astype(np.int32)
        at += len(new)
        found, _ = beam_search(x, edges, start, x[new], beam)
        edges[new] = robust_prune(x, new, found, degree, alpha)
        ends, origin = edges[new].ravel(), np.repeat(new, degree)
        ends, origin = ends[ends >= 0], origin[ends >= 0]
        by = np.argsort(ends, kind="stable")
        ends, origin = ends[by], origin[by]
        nodes, first, count = np.unique(ends, return_index=True, return_counts=True)
        for wide in (count <= degree, count > degree):  # few new edges to most nodes, many to a few
            if wide.any():
                most = int(count[wide].max())
                place = np.arange(most)[None, :]
                more = np.where(place < count[wide][:, None], origin[np.minimum(first[wide][:, None] + place, len(origin) - 1)], -1)
                both = np.concatenate([edges[nodes[wide]], more], 1).astype(np.int32)
                full = (both >= 0).sum(1) > degree
                if full.any():
                    edges[nodes[wide][full]] = robust_prune(x, nodes[wide][full].astype(np.int32), both[full], degree, alpha)
                if (~full).any():
                    packed = np.sort(both[~full], 1)[:, ::-1][:, :degree]
                    edges[nodes[wide][~full]] = packed
    return start, edges


def index(vectors: DataFrame, shard_size: int | None = None) -> DataFrame:
    """(id long, vec array of float or double) -> the graph's nodes, written to the shared folder.

    Repeated rows are ids of one node; an empty table gives an empty index. shard_size: by default as many as make
    SHARDS shards, within LEAST_SHARD and MOST_SHARD.
    """
    kind = vectors.schema["vec"].dataType.simpleString()
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    band = F.coalesce(F.floor((F.log2(F.when(top > 0, top)) + BAND // 2) / BAND), F.lit(-9999)).cast("int")
    vectors = vectors.select("id", "vec", F.size("vec").alias("dims"), band.alias("band"))
    n = vectors.count()
    shards = max(1, -(-n // (shard_size or min(MOST_SHARD, max(LEAST_SHARD, n // SHARDS)))))

    def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, back = np.unique(np.stack(rows["vec"].to_numpy()), axis=0, return_inverse=True)
        start, edges = build(*scaled(x), batch=min(1024, max(256, len(x) // 64)))
        order = np.lexsort((rows["id"].to_numpy(), back.ravel()))
        ids = np.split(rows["id"].to_numpy()[order], np.flatnonzero(np.diff(back.ravel()[order])) + 1)
        return pd.DataFrame({"shard": key[0], "dims": key[1], "band": key[2], "node": np.arange(len(x)), "start": start, "ids": ids, "vec": list(x), "edges": [e[e >= 0] for e in edges]})

    dealt = vectors.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return as_table(dealt.groupBy("s", "dims", "band").applyInPandas(graph, f"shard long, dims int, band int, node int, start int, ids array<long>, vec {kind}, edges array<int>"))


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, beam: int = 96) -> DataFrame:
    """query_id, rank, id, score: for each query (id, vec) the k nearest nodes found, itself excluded.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; with fewer
    candidates all found are returned. Only vectors of one length meet. Vectors that are equal share a node, of which
    each query sees the k + 1 smallest ids: no more can be among its k nearest. A repeated query shares one ranking with
    its copies; empty tables give an empty one.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    graph, to = ["shard", "dims", "band"], ["_shard", "_dims", "_band"]
    shards = nodes.select(*[F.col(c).alias(t) for c, t in zip(graph, to)]).distinct()
    left = nodes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = queries.select("id", "vec", F.size("vec").alias("_dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("part")).join(shards, "_dims")

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            a = a.sort_values("node")
            whole, ids = np.stack(a["vec"].to_numpy()).astype(np.float64), a["ids"].to_numpy()
            edges = np.full((len(a), max(1, a["edges"].map(len).max())), -1, np.int32)
            for i, e in enumerate(a["edges"]):
                edges[i, : len(e)] = e
            wanted, own = np.stack(b["vec"].to_numpy()).astype(np.float64), b["id"].to_numpy()
            x, q = scaled(whole, wanted)
            for s in range(0, len(q), 128):
                found, _ = beam_search(x, edges, int(a["start"].iloc[0]), q[s : s + 128], max(beam, k + 1))
                for i, row in enumerate(found, s):
                    row = row[row >= 0][: 2 * k + 2]
                    score = np.sqrt(((whole[row] - wanted[i]) ** 2).sum(1))
                    hits = [(d, c) for d, r in zip(score.tolist(), row) for c in ids[r][: k + 1].tolist() if c != own[i]]
                    out += [(int(own[i]), c, d) for d, c in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = left.groupBy(*graph, "block").cogroup(right.groupBy(*to, "part")).applyInPandas(find, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows whose vector is neither null nor zero and has finite components only, and whose id is not null; the type of its components stays."""
    v = F.col(vector_col)
    return df.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def op10_ann_graph(spark, sf_dir: str) -> DataFrame:
    """Edge rows: see usable, index and search. Distances that double precision can't tell apart may fall to any of their ids."""
    rows = as_table(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return search(index(rows), rows.where("id % 100 = 0")).withColumnRenamed("id", "vec_id")
