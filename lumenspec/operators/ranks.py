"""Ranks and best lists of queries against a whole library of vectors: matrix products by blocks, of which each block gives back counts or its best, never its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.operators.matching import LIBRARY_BLOCK, QUERY_BLOCK, block_scores, top_k
from lumenspec.operators.studies import MISSING
from lumenspec.tables import written

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
DIGITS = 6  # decimals that scores are rounded to before they are compared


def with_truth(queries: DataFrame, library: DataFrame, score: Score) -> DataFrame:
    """`queries` (query, answer, vec) with truth, the score of its answer (the best, if it stands several times; null if the
    library lacks it), and truth_measured, the same among rows of the library that are `measured`, if it has that column."""
    flag = F.col("measured") if "measured" in library.columns else F.lit(True)
    sides = queries.select("query", "answer", "vec").join(library.select(F.col("lib").alias("answer"), F.col("vec").alias("_v"), flag.alias("_m")), "answer").where("query <> answer and size(vec) = size(_v)")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [float(score(np.asarray(x, float)[None], np.asarray(y, float)[None])[0, 0]) for x, y in zip(b["vec"], b["_v"])]
            yield pd.DataFrame({"query": b["query"], "_m": b["_m"], "truth": np.round(found, DIGITS)})

    scored = sides.select("query", "vec", "_v", "_m").mapInPandas(one, "query long, _m boolean, truth double")
    best = scored.groupBy("query").agg(F.max("truth").alias("truth"), F.max(F.when(F.col("_m"), F.col("truth"))).alias("truth_measured"))
    return queries.join(best, "query", "left")


def _rounded(s: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Scores in DIGITS decimals; NaN for a row and itself."""
    return np.where(other, np.round(s, DIGITS), np.nan)


def answer_counts(queries: DataFrame, library: DataFrame, score: Score) -> DataFrame:
    """(query, score, better, worse, candidates) of queries (query, answer, vec) whose answer the library holds: how many rows score above and below it."""
    known = with_truth(queries, library, score).where("truth is not null").select("query", "vec", "truth")

    def count(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        s, t = _rounded(s, other), a["truth"].to_numpy()[:, None]
        return pd.DataFrame({"query": a["query"], "score": a["truth"], "better": (s > t).sum(1), "worse": (s < t).sum(1), "candidates": other.sum(1)})

    parts = block_scores(known, library.select("lib", "vec"), score, count, "query long, score double, better long, worse long, candidates long")
    return parts.groupBy("query", "score").agg(*[F.sum(c).alias(c) for c in ("better", "worse", "candidates")])


def best_rows(queries: DataFrame, library: DataFrame, score: Score, k: int, above_truth: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """(query, rank, lib, score, columns of the library): the k best of each query, ties to the smaller lib; with above_truth
    of those that score above `truth` (see with_truth) only (W3, W7, A10). A block gives back k rows a query at most."""
    mine = ["query", "vec", *(["truth"] if above_truth else [])]
    kinds = "".join(f", `{c}` {library.schema[c].dataType.simpleString()}" for c in columns)

    def best(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        order = b["lib"].to_numpy().argsort(kind="stable")
        s = _rounded(s, other)[:, order]
        out = []
        for i, row in enumerate(s):
            some = np.flatnonzero(row > a["truth"].iloc[i] if above_truth else ~np.isnan(row))
            if len(some) > k:
                least = np.partition(row[some], len(some) - k)[len(some) - k]
                high = some[row[some] > least]
                some = np.concatenate([high, some[row[some] == least][: k - len(high)]])
            out.append(pd.DataFrame({"query": a["query"].iloc[i], "lib": b["lib"].to_numpy()[order[some]], "score": row[some]} | {c: b[c].to_numpy()[order[some]] for c in columns}))
        return pd.concat(out)

    found = block_scores(queries.select(*mine), library.select("lib", "vec", *columns), score, best, f"query long, lib long, score double{kinds}")
    return top_k(found, k, "query")


def best_places(queries: DataFrame, library: DataFrame, score: Score) -> DataFrame:
    """(query, best): the 0-based place of the best row of each query's key among all rows, ties to the smaller lib.

    queries are (query, query_key, vec), the library (lib, lib_key, vec). One pass finds the best row of the key, a
    second counts what lies above it. A query whose key no other row has drops out.
    """

    def own(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        order = b["lib"].to_numpy().argsort(kind="stable")
        same = other & (a["query_key"].to_numpy()[:, None] == b["lib_key"].to_numpy()[None, :])
        s = np.nan_to_num(_rounded(s, same), nan=-np.inf)[:, order]
        pick = s.argmax(1)
        out = pd.DataFrame({"query": a["query"], "score": s[np.arange(len(s)), pick], "lib": b["lib"].to_numpy()[order][pick]})
        return out[np.isfinite(out["score"])]

    def above(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        s, t = _rounded(s, other), a["top"].to_numpy()[:, None]
        before = b["lib"].to_numpy()[None, :] < a["top_lib"].to_numpy()[:, None]
        return pd.DataFrame({"query": a["query"], "n": ((s > t) | ((s == t) & before)).sum(1)})

    found = block_scores(queries.select("query", "query_key", "vec"), library.select("lib", "lib_key", "vec"), score, own, "query long, score double, lib long")
    top = found.groupBy("query").agg(F.max(F.struct(F.col("score").alias("top"), (-F.col("lib")).alias("_l"))).alias("_t"))
    known = queries.select("query", "vec").join(top, "query").select("query", "vec", F.col("_t.top").alias("top"), (-F.col("_t._l")).alias("top_lib"))
    return block_scores(known, library.select("lib", "vec"), score, above, "query long, n long").groupBy("query").agg(F.sum("n").alias("best"))


PLACES_BLOCK = 512  # queries of a block whose lists of scores are packed


def half_away(x: np.ndarray) -> np.ndarray:
    """Scores in millionths, halves away from zero, as SQL rounds them; what is no number comes after all numbers."""
    y = x * 10.0**DIGITS
    whole = np.trunc(y)
    y = whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0)
    return np.where(np.isnan(y), -(1 << 30), np.clip(y, -(1 << 29), 1 << 29)).astype(np.int32)


def packed(points: np.ndarray) -> bytes:
    """Falling integers as their differences, byte by byte of all: the higher bytes are mostly zeros, which a shuffle's compression takes away."""
    steps = np.diff(points, prepend=np.int32(0)).astype("<i4")
    steps[1:] *= -1
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel().copy()
    steps[1:] *= -1
    return np.cumsum(steps, dtype=np.int32)


def key_places(queries: DataFrame, library: DataFrame, score: Score) -> DataFrame:
    """(query, best, worst, mean) of queries (query, query_key, vec) in a library (lib, lib_key, vec): 0-based best, worst and
    mean place of the rows with the query's key among all rows, ties to the smaller lib (W5, W6).

    The mean needs every place, so every score is sorted; yet no pair is a row. The library lies in ranges of lib; a block
    gives back for each query one list of its scores in order, about 1.5 bytes each, and one bit each for the key. A query's lists
    meet in one task, which needs about 20 bytes a row of the library; equal scores stand by range, then as their range had them.
    """
    some = -(-library.count() // LIBRARY_BLOCK)
    ranges = written(library.repartitionByRange(max(1, some), "lib").withColumn("block", F.spark_partition_id()))

    def listed(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        order = b["lib"].to_numpy().argsort(kind="stable")
        same = a["query_key"].to_numpy()[:, None] == b["lib_key"].to_numpy()[None, order]
        s, other = half_away(s)[:, order], other[:, order]
        out = []
        for query, rows in a.groupby("query", sort=False).indices.items():
            keep = other[rows].T.ravel()  # by lib, also where a query stands several times
            points, key = s[rows].T.ravel()[keep], same[rows].T.ravel()[keep]
            falling = np.argsort(-points, kind="stable")
            out.append((query, b["block"].iloc[0], len(points), packed(points[falling]), np.packbits(key[falling]).tobytes()))
        return pd.DataFrame(out, columns=["query", "part", "n", "points", "keys"])

    def places(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["part"].to_numpy(), kind="stable")
        points, key = [], []
        for n, x, y in ((rows[c][int(i)].as_py() for c in ("n", "points", "keys")) for i in order):
            points.append(unpacked(x))
            key.append(np.unpackbits(np.frombuffer(y, np.uint8), count=n).astype(bool))
        points, key = np.concatenate(points), np.concatenate(key)
        at = np.flatnonzero(key[np.argsort(-points, kind="stable")])
        values = [at[0], at[-1], at.sum(), len(at)] if len(at) else []
        found = [pa.array([v], pa.int64()) for v in values] or [pa.array([], pa.int64())] * 4
        return pa.Table.from_arrays([rows["query"].combine_chunks()[: len(found[0])], *found], ["query", "best", "worst", "total", "n"])

    lists = block_scores(queries.select("query", "query_key", "vec"), ranges.select("lib", "lib_key", "vec", "block"), score, listed, "query long, part int, n long, points binary, keys binary", PLACES_BLOCK)
    found = lists.groupBy("query").applyInArrow(places, "query long, best long, worst long, total long, n long")
    return found.select("query", F.col("best").cast("int").alias("best"), F.col("worst").cast("int").alias("worst"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))


def counts_above(queries: DataFrame, library: DataFrame, score: Score, least: float) -> DataFrame:
    """(query, similar): how many rows score above `least`."""

    def count(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query": a["query"], "similar": (np.where(other, s, np.nan) > least).sum(1)})

    return block_scores(queries, library, score, count, "query long, similar long").groupBy("query").agg(F.sum("similar").alias("similar"))


def tiered_answers(queries: DataFrame, library: DataFrame, score: Score, enough: float = 0.95) -> DataFrame:
    """(query, tier, rank, score) of queries (query, answer, vec) in a library with `measured`: ranks among measured rows
    where their best score is above `enough`, else among all; an answer that the tier lacks has score 0 and rank MISSING (J8)."""
    known = with_truth(queries, library, score).select("query", "vec", "truth", "truth_measured")

    def count(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        s, m = _rounded(s, other), b["measured"].to_numpy(bool)[None, :]
        top = np.where(m, s, -np.inf)
        return pd.DataFrame({"query": a["query"], "top": np.nan_to_num(top, nan=-np.inf).max(1), "am": ((s > a["truth_measured"].to_numpy()[:, None]) & m).sum(1), "af": (s > a["truth"].to_numpy()[:, None]).sum(1)})

    parts = block_scores(known, library.select("lib", "vec", "measured"), score, count, "query long, top double, am long, af long")
    one = parts.groupBy("query").agg(F.max("top").alias("top"), F.sum("am").alias("am"), F.sum("af").alias("af")).join(known.select("query", "truth", "truth_measured"), "query")
    first = F.col("top") > enough
    rank = lambda t, n: F.when(F.col(t).isNull(), F.lit(MISSING).cast("long")).otherwise(F.lit(1) + F.col(n))
    return one.select("query", F.when(first, "measured").otherwise("all").alias("tier"), F.when(first, rank("truth_measured", "am")).otherwise(rank("truth", "af")).alias("rank"), F.coalesce(F.when(first, F.col("truth_measured")).otherwise(F.col("truth")), F.lit(0.0)).alias("score"))


def _parts(counts: DataFrame, most: int, name: str) -> DataFrame:
    """(_cell, name): into how many parts a cell's rows are cut."""
    return counts.groupBy("_cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def windowed_answers(queries: DataFrame, library: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], width: float) -> DataFrame:
    """(query, rank, candidates) of queries (query, answer, mass, ...) among the library's rows (lib, mass, ...) whose mass is
    less than `width` away, by score(queries, rows), a matrix of two tables (J7, F2): 1 + how many score above the answer.

    Both sides lie in cells of the window's width, a query in three; a cell is cut into parts of at most
    LIBRARY_BLOCK by QUERY_BLOCK rows, about, so a mass that many share is dealt to many tasks. A part gives back counts.
    Queries whose answer is not within their window drop out; a row does not meet its own id.
    """
    cell = F.floor(F.col("mass") / width)
    near = lambda a, b: (a["query"].to_numpy()[:, None] != b["lib"].to_numpy()[None, :]) & (np.abs(a["mass"].to_numpy()[:, None] - b["mass"].to_numpy()[None, :]) < width)
    own = [c for c in library.columns if c != "lib"]
    both = queries.join(library.select(F.col("lib").alias("answer"), *[F.col(c).alias(f"_b_{c}") for c in own]), "answer").where((F.col("query") != F.col("answer")) & (F.abs(F.col("mass") - F.col("_b_mass")) < width))
    mine = [c for c in queries.columns if c != "answer"]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = [float(score(d.iloc[[i]], d.iloc[[i]][[f"_b_{c}" for c in own]].rename(columns=lambda c: c[3:]))[0, 0]) for i in range(len(d))]
            yield pd.DataFrame({"query": d["query"], "truth": np.round(found, DIGITS)})

    truth = both.mapInPandas(one, "query long, truth double").groupBy("query").agg(F.max("truth").alias("truth"))
    known = written(queries.select(*mine).join(truth, "query"))
    left = known.withColumn("_cell", F.explode(F.array(*[cell + k for k in (-1, 0, 1)])))
    right = library.withColumn("_cell", cell)
    sizes = _parts(left, QUERY_BLOCK, "_qs").join(_parts(right, LIBRARY_BLOCK, "_ls"), "_cell")
    dealt = lambda d, key, mine, me, theirs, it: d.join(sizes, "_cell").withColumn(me, F.pmod(F.xxhash64(key), F.col(mine)).cast("int")).withColumn(it, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("_qs", "_ls")
    keys = ["_cell", "_q", "_l"]

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "better": [], "candidates": []})
        some = near(a, b)
        s = np.where(some, np.round(score(a, b), DIGITS), np.nan)
        return pd.DataFrame({"query": a["query"], "better": (s > a["truth"].to_numpy()[:, None]).sum(1), "candidates": some.sum(1)})

    parts = dealt(left, "query", "_qs", "_q", "_ls", "_l").groupBy(*keys).cogroup(dealt(right, "lib", "_ls", "_l", "_qs", "_q").groupBy(*keys)).applyInPandas(count, "query long, better long, candidates long")
    return parts.groupBy("query").agg((F.lit(1) + F.sum("better")).alias("rank"), F.sum("candidates").alias("candidates"))
