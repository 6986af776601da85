"""Joins of spectra: mass windows, peak alignment, scores, library search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part, whole))


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Pairs with |x - y| <= width, as an equi-join on cells of that width (J1, F1, F2): the left side goes to three cells.
    A width of 0 or less pairs equal values only."""
    if width <= 0:
        return left.join(right, F.col(x) == F.col(y))
    a = left.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(x) / width) + k for k in (-1, 0, 1)])))
    b = right.withColumn("_own", F.floor(F.col(y) / width))
    return a.join(b, (F.col("_cell") == F.col("_own")) & (F.abs(F.col(x) - F.col(y)) <= width)).drop("_cell", "_own")


BLOCK = 2048  # rows of one side that a block of pairs has at most


def band_pairs(left: DataFrame, right: DataFrame, x: str, y: str, width: float, block: int = BLOCK) -> DataFrame:
    """The rows of band_join for a width above 0, in an order that files hold in few bytes: the rows of the right side that have
    one y, by y, as a whole with each of their rows of the left side, by x. What repeats then repeats in runs: a row of the left side, and the difference.

    Both sides of a cell are packed into ordered lists of at most `block` rows; what is shuffled after the cells is a row a
    pair of lists, never a pair of rows. Columns have to be orderable and their names differ.
    """

    def packed(rows: DataFrame, value: str, name: str) -> DataFrame:
        others = [c for c in rows.columns if c not in ("_cell", value)]
        at = F.row_number().over(Window.partitionBy("_cell").orderBy(value, *others))
        parts = rows.where(F.col("_cell").isNotNull()).withColumn("_part", F.floor((at - 1) / block))
        part = ["_cell", F.col("_part").alias(f"{name}_part")]
        if name == "_left":
            return parts.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(value, *others))).alias(name))
        alike = parts.groupBy(*part, F.col(value).alias("_value")).agg(F.sort_array(F.collect_list(F.struct(value, *others))).alias("_rows"))
        return alike.groupBy("_cell", f"{name}_part").agg(F.sort_array(F.collect_list(F.struct("_value", "_rows"))).alias(name))

    cell = lambda v: F.floor(F.col(v) / width)
    a = packed(left.withColumn("_cell", F.explode(F.array(*[cell(x) + k for k in (-1, 0, 1)]))), x, "_left")
    b = packed(right.withColumn("_cell", cell(y)), y, "_right")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = b.join(a, "_cell").repartition(tasks, "_cell", "_right_part", "_left_part").select("_right", "_left")
    met = lists.select("_left", F.inline("_right")).select("_value", "_rows", F.inline("_left")).where(F.abs(F.col(x) - F.col("_value")) <= width)
    return met.select(*left.columns, F.inline("_rows")).select(*left.columns, *right.columns)


def align(p_mz: np.ndarray, p_i: np.ndarray, q_mz: np.ndarray, q_i: np.ndarray, absolute: float, ppm: float) -> list[tuple[int, int]]:
    """One-to-one pairs in m/z order, each within tolerance of the larger mass (strictly), of the highest sum of
    (intensity product + 1); among equals the way that leaves out q first, then p (J5)."""
    n, m = len(p_mz), len(q_mz)
    larger = np.maximum(p_mz[:, None], q_mz[None, :])
    ok = np.abs(p_mz[:, None] - q_mz[None, :]) < np.maximum(absolute, larger * ppm / 1e6)
    gain = np.where(ok, p_i[:, None] * q_i[None, :] + 1.0, -np.inf)
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        best[i, 1:] = np.maximum(best[i - 1, 1:], best[i - 1, :-1] + gain[i - 1])
        best[i] = np.maximum.accumulate(best[i])
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i, j - 1]:
            j -= 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


SMALL = 256  # cells up to which plain numbers are faster than arrays


def align_small(p_mz: list[float], p_i: list[float], q_mz: list[float], q_i: list[float], absolute: float, ppm: float) -> list[tuple[int, int]]:
    """The same as align, for short spectra."""
    n, m = len(p_mz), len(q_mz)
    if n * m > SMALL:
        return align(*[np.asarray(x, float) for x in (p_mz, p_i, q_mz, q_i)], absolute, ppm)
    best = [[0.0] * (m + 1)]
    for x, w in zip(p_mz, p_i):
        last, row, top = best[-1], [0.0], 0.0
        for j in range(m):
            y = q_mz[j]
            if last[j + 1] > top:
                top = last[j + 1]
            if abs(x - y) < max(absolute, max(x, y) * ppm / 1e6):
                top = max(top, last[j] + (w * q_i[j] + 1.0))
            row.append(top)
        best.append(row)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i][j - 1]:
            j -= 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def batch_scores(p_mz: list, p_i: list, q_mz: list, q_i: list, pairs: list[list[tuple[int, int]]]) -> dict[str, np.ndarray]:
    """pair_scores of many pairs of spectra at once: sums over all their peaks by owner."""
    n = len(pairs)
    flat = lambda x: np.array([v for row in x for v in row], float)
    sizes = {k: np.array([len(r) for r in x], np.int64) for k, x in (("p", p_mz), ("q", q_mz), ("n", pairs))}
    owner = {k: np.repeat(np.arange(n), v) for k, v in sizes.items()}
    first = {k: np.cumsum(v) - v for k, v in sizes.items()}
    a, b = (np.array([x[k] for row in pairs for x in row], np.int64) + first[s][owner["n"]] for k, s in ((0, "p"), (1, "q")))
    p_mz, p_i, q_mz, q_i = flat(p_mz), flat(p_i), flat(q_mz), flat(q_i)
    total = lambda k, x: np.bincount(owner[k], x, n)

    def dot(power_i: float, power_m: float) -> np.ndarray:
        p, q = p_i**power_i * p_mz**power_m, q_i**power_i * q_mz**power_m
        whole = total("p", p * p) * total("q", q * q)
        return np.divide(total("n", p[a] * q[b]) ** 2, whole, out=np.zeros(n), where=(whole != 0) & (sizes["n"] > 0))

    share = lambda x, y: np.divide(100 * x, y, out=np.zeros(n), where=y != 0)
    both, matched = sizes["p"] + sizes["q"], sizes["n"]
    out = {"dot": dot(0.5, 0.5), "stein": dot(0.6, 3.0), "precision": share(matched, sizes["q"]), "recall": share(matched, sizes["p"])}
    found_p, found_q = total("n", p_i[a]), total("n", q_i[b])
    out |= {"weighted_recall": share(found_p, total("p", p_i)), "weighted_precision": share(found_q, total("q", q_i))}
    out |= {"jaccard": np.divide(2 * matched, both, out=np.zeros(n), where=both != 0), "weighted_jaccard": (found_p + found_q) / 200}
    return out | {"combined": 100 * out["dot"] + 100 * out["jaccard"] + out["weighted_precision"] + out["weighted_recall"], "matched": matched.astype(np.int32)}


SCORES = "dot double, stein double, precision double, recall double, weighted_recall double, weighted_precision double, jaccard double, weighted_jaccard double, combined double, matched int"


def pair_scores(p_mz, p_i, q_mz, q_i, pairs: list[tuple[int, int]]) -> dict[str, float]:
    """A1 to A9 of measured p and predicted q. No pairs: zeros."""
    a, b = (np.array([x[k] for x in pairs], int) for k in (0, 1))

    def dot(power_i: float, power_m: float) -> float:
        w = lambda i, m: i**power_i * m**power_m
        whole = (w(p_i, p_mz) ** 2).sum() * (w(q_i, q_mz) ** 2).sum()
        return float((w(p_i[a], p_mz[a]) * w(q_i[b], q_mz[b])).sum() ** 2 / whole) if len(pairs) and whole else 0.0

    share = lambda x, y: float(100 * x / y) if y else 0.0
    out = {"dot": dot(0.5, 0.5), "stein": dot(0.6, 3.0), "precision": share(len(pairs), len(q_mz)), "recall": share(len(pairs), len(p_mz))}
    out |= {"weighted_recall": share(p_i[a].sum(), p_i.sum()), "weighted_precision": share(q_i[b].sum(), q_i.sum())}
    out |= {"jaccard": 2 * len(pairs) / (len(p_mz) + len(q_mz)) if len(p_mz) + len(q_mz) else 0.0, "weighted_jaccard": float((p_i[a].sum() + q_i[b].sum()) / 200)}
    return out | {"combined": 100 * out["dot"] + 100 * out["jaccard"] + out["weighted_precision"] + out["weighted_recall"], "matched": len(pairs)}


def score_aligned(pairs: DataFrame, absolute: float, ppm: float) -> DataFrame:
    """Rows with p and q (arrays of struct mz, intensity; normalised, sorted) -> the same keys with all scores. Arrow batches."""
    keys = [c for c in pairs.columns if c not in ("p", "q")]
    arrays = [F.col(f"{s}.{f}").alias(f"_{s}_{f}") for s in ("p", "q") for f in ("mz", "intensity")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sides = [[v.tolist() for v in b[c]] for c in ("_p_mz", "_p_intensity", "_q_mz", "_q_intensity")]
            rows = batch_scores(*sides, [align_small(*x, absolute, ppm) for x in zip(*sides)])
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in SCORES.split(", ")])], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema) + ", " + SCORES
    return pairs.select(*keys, *arrays).mapInPandas(score, schema)


#: Scores by the names that reports and settings use.
SCORE_NAMES = {"DotProduct": "dot", "OrigSteinDotProduct": "stein", "Precision": "precision", "Recall": "recall", "WeightedPrecision": "weighted_precision", "WeightedRecall": "weighted_recall", "Jaccard": "jaccard", "WeightedJaccard": "weighted_jaccard", "Combined": "combined"}


def scores_by_name(pairs: DataFrame, names: Sequence[str], absolute: float, ppm: float) -> DataFrame:
    """The scores of score_aligned that the names ask for (X1); an unknown name is an error before anything runs."""
    unknown = [n for n in names if n not in SCORE_NAMES]
    if unknown:
        raise ValueError(f"no score is called {', '.join(unknown)}; there are {', '.join(SCORE_NAMES)}")
    keys = [c for c in pairs.columns if c not in ("p", "q")]
    return score_aligned(pairs, absolute, ppm).select(*keys, *[SCORE_NAMES[n] for n in names])


def as_arrays(peaks: DataFrame, name: str, key: str = "spec_id") -> DataFrame:
    """One row a spectrum: its peaks as a sorted array."""
    return peaks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity")))).alias(name))


def match_bins(analytes: DataFrame, library: DataFrame, k: int | None = 100, pairs: DataFrame | None = None) -> DataFrame:
    """(analyte, rank, lib, score): squared cosine of sqrt(I m) over equal bins, the k best of each analyte.

    With `pairs` (analyte, lib), such as those of a mass window, only they meet. Else a pair meets once a shared bin; a
    frequent bin's postings are dealt by Spark's skew handling. Ties go to the smaller lib. Pairs without a shared bin
    have no row; a spectrum without weight (no peak above m/z 0, or no intensity) scores 0.
    """
    weight = F.col("intensity") * F.col("mz")
    side = lambda d, name: d.select(F.col("spec_id").alias(name), "mz", F.sqrt(weight).alias(f"_{name}"), F.sum(weight).over(Window.partitionBy("spec_id")).alias(f"_{name}_norm"))
    a, b = side(analytes, "analyte"), side(library, "lib")
    met = a.join(b, "mz") if pairs is None else pairs.select("analyte", "lib").join(a, "analyte").join(b, ["lib", "mz"])
    norms = [F.max(f"_{name}_norm").alias(f"_{name}_norm") for name in ("analyte", "lib")]
    dots = met.groupBy("analyte", "lib").agg(F.sum(F.col("_analyte") * F.col("_lib")).alias("_dot"), *norms)
    scored = dots.select("analyte", "lib", F.round(share(F.col("_dot") * F.col("_dot"), F.col("_analyte_norm") * F.col("_lib_norm")), 6).alias("score"))
    return top_k(scored, k) if k else scored


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b; 0 where one is zero."""
    whole = np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])
    return np.divide(a @ b.T, whole, out=np.zeros_like(whole), where=whole != 0)


def bit_jaccards(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of 0/1 rows; NaN if both are empty (A10)."""
    both = a @ b.T
    either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.divide(both, either, out=np.full_like(both, np.nan), where=either != 0)


def bit_dices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 |a & b| / (|a| + |b|) of 0/1 rows; NaN if both are empty."""
    whole = a.sum(1)[:, None] + b.sum(1)[None, :]
    return np.divide(2 * (a @ b.T), whole, out=np.full_like(whole, np.nan), where=whole != 0)


def bit_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of places that agree, of 0/1 rows."""
    return 1 - (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)) / float(a.shape[1])


QUERY_BLOCK, LIBRARY_BLOCK = 256, 4096


def block_scores(queries: DataFrame, library: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], reduce: Callable | None = None, reduced: str = "", query_block: int | None = None) -> DataFrame:
    """(query, lib, score, and the other columns of both sides) for queries (query, vec, ...) and a library (lib, vec, ...).

    Both sides lie in blocks by a hash of their id; a task scores one block of queries against one of the library by a
    product of matrices, in Arrow batches. A row does not meet its own id, only vectors of one length meet, and NaN is null.
    With `reduce`, a block's rows are what reduce(queries, library, scores, others) makes of it, of the schema `reduced`;
    others marks the pairs that are not of one id. Without it every pair is a row, which only small libraries can afford.
    A library with a column `block` (int, from 0) lies in these blocks instead.
    """
    n, q = library.count(), queries.count()
    rounds, blocks = max(1, -(-q // (query_block or QUERY_BLOCK))), max(1, -(-n // LIBRARY_BLOCK))
    if "block" in library.columns:
        blocks = 1 + (library.agg(F.max("block")).first()[0] or 0)
    others = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda d, own, parts, mine, k, theirs: d.select(F.size("vec").alias("_dims"), (F.col("block") if "block" in d.columns else F.pmod(F.xxhash64(own), F.lit(parts)).cast("int")).alias(mine), others(k).alias(theirs), *[F.col(c).alias(c) for c in d.columns])  # noqa: E731  (new aliases: both sides may come from one table)
    left, right = dealt(queries, "query", rounds, "_q", blocks, "_b"), dealt(library, "lib", blocks, "_b", rounds, "_q")
    left_more, right_more = ([c for c in d.columns if c not in (own, "vec")] for d, own in ((queries, "query"), (library, "lib")))
    names = [c.split()[0].strip("`") for c in reduced.split(", ")] if reduce else ["query", "lib", "score", *left_more, *right_more]
    schema = ", ".join(["query long", "lib long", "score double", *[f"`{c}` {d.schema[c].dataType.simpleString()}" for d, some in ((queries, left_more), (library, right_more)) for c in some]])

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        x, y = (np.stack(d["vec"].to_numpy()).astype(float) for d in (a, b))
        if reduce:
            return reduce(a, b, score(x, y), a["query"].to_numpy()[:, None] != b["lib"].to_numpy()[None, :])[names]
        out = {"query": np.repeat(a["query"].to_numpy(), len(b)), "lib": np.tile(b["lib"].to_numpy(), len(a)), "score": score(x, y).ravel()}
        out |= {c: np.repeat(a[c].to_numpy(), len(b)) for c in left_more} | {c: np.tile(b[c].to_numpy(), len(a)) for c in right_more}
        rows = pd.DataFrame(out)
        return rows[rows["query"] != rows["lib"]]

    keys = ["_q", "_b", "_dims"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pairs, reduced or schema)
    return scored if reduce else scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def top_k(scored: DataFrame, k: int, by: str = "analyte", tie: str = "lib") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bit_jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of bit strings through their set places; null if both are empty (A10)."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def combined_score(spectrum: Column, bits: Column) -> Column:
    """0.7 spectrum + 0.3 fingerprint; the spectrum alone where there is no fingerprint score."""
    return F.when(bits.isNull(), spectrum).otherwise(0.7 * spectrum + 0.3 * bits)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
