"""Candidate studies: ranks of known answers among scored candidates, tiers of libraries, further scores.

Scored candidates are rows (query, lib, score, answer): `answer` is the lib that is right for the query. Where an answer
stands more than once its best score counts, since rows of a table have no order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MISSING = 99999  # rank of an answer that the library does not hold


def _query() -> WindowSpec:
    return Window.partitionBy("query")


def _hit() -> Column:
    return F.col("lib") == F.col("answer")


def mixed_score(spectrum: Column, bits: Column, share: float = 0.3) -> Column:
    """share of the spectrum's score, the rest of the fingerprint's."""
    return share * spectrum + (1 - share) * bits


def study_ranks(scored: DataFrame) -> DataFrame:
    """(query, rank, candidates) of queries whose answer is a candidate: 1 + number of higher scores."""
    rows = scored.withColumn("_true", F.max(F.when(_hit(), F.col("score"))).over(_query())).where("_true is not null")
    return rows.groupBy("query").agg((F.lit(1) + F.sum((F.col("score") > F.col("_true")).cast("long"))).alias("rank"), F.count("*").alias("candidates"))


def better_than_answer(scored: DataFrame, most: int = 100) -> DataFrame:
    """(query, place, lib, score): the `most` best of the candidates above the answer, best first."""
    rows = scored.withColumn("_true", F.max(F.when(_hit(), F.col("score"))).over(_query())).where(F.col("score") > F.col("_true"))
    place = F.row_number().over(_query().orderBy(F.desc("score"), "lib"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("query", "place", "lib", "score")


def tiered_ranks(scored: DataFrame, enough: float = 0.95) -> DataFrame:
    """(query, tier, rank, score): ranks among `measured` rows where their best score is above `enough`, else among all;
    an answer that the tier does not hold has score 0 and rank MISSING (J8)."""
    measured, score = F.col("measured"), F.col("score")
    top = {"_top": F.when(measured, score), "_m": F.when(measured & _hit(), score), "_f": F.when(_hit(), score)}
    rows = scored.withColumns({k: F.max(v).over(_query()) for k, v in top.items()})
    above = lambda c, extra: F.sum((extra & (score > F.col(c))).cast("long"))
    one = rows.groupBy("query").agg(*[F.max(k).alias(k) for k in top], above("_m", measured).alias("_am"), above("_f", F.lit(True)).alias("_af"))
    first = F.coalesce(F.col("_top") > enough, F.lit(False))
    rank = lambda s, n: F.when(F.col(s).isNull(), F.lit(MISSING).cast("long")).otherwise(F.lit(1) + F.col(n))
    return one.select("query", F.when(first, "measured").otherwise("all").alias("tier"), F.when(first, rank("_m", "_am")).otherwise(rank("_f", "_af")).alias("rank"), F.coalesce(F.when(first, F.col("_m")).otherwise(F.col("_f")), F.lit(0.0)).alias("score"))


def best_match(scored: DataFrame) -> DataFrame:
    """(query, lib, lib_key): the highest score, ties to the smaller lib, with the key found there."""
    return scored.groupBy("query").agg(F.max_by(F.struct("lib", "lib_key"), F.struct("score", -F.col("lib"))).alias("_b")).select("query", "_b.*")


def ranked_over_energies(scored: DataFrame, k: int | None = None) -> DataFrame:
    """(query, rank, lib, score): scores of (query, lib, energy) summed, the k best or all."""
    summed = scored.groupBy("query", "lib").agg(F.sum("score").alias("score"))
    rows = summed.withColumn("rank", F.row_number().over(_query().orderBy(F.desc("score"), "lib")))
    return rows.where(F.col("rank") <= k) if k else rows


def average_rank(ranks: DataFrame) -> DataFrame:
    """One row: number of queries, mean rank cut to an integer, mean score."""
    return ranks.agg(F.count("*").alias("queries"), F.floor(F.sum("rank") / F.count("*")).alias("rank"), F.round(F.avg("score"), 6).alias("score"))


def dice(a: Column, b: Column) -> Column:
    """2 |a & b| / (|a| + |b|) of sets as arrays; null if both are empty."""
    return 2 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0))


def simple_matching(a: Column, b: Column, bits: int) -> Column:
    """Share of `bits` places that agree, of sets of places."""
    return 1 - (F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))) / F.lit(float(bits))


def top_set(peaks: DataFrame, n: int, key: Sequence[str] = ("spec_id",)) -> DataFrame:
    """(key, top): integer m/z of the n most intense peaks as a set, ties to the smaller m/z."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("intensity")).alias("i"), F.col("mz").alias("m")))), 1, n)
    return peaks.groupBy(*key).agg(best.alias("_b")).select(*key, F.array_distinct(F.transform("_b", lambda x: x["m"].cast("int"))).alias("top"))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of peak sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def retention_score(a: Column, b: Column) -> Column:
    """exp(-|a - b| / 1000), 0 where either is missing."""
    return F.coalesce(F.exp(-F.abs(a - b) / 1000), F.lit(0.0))


def shared_keys(parts: DataFrame, key: str, part: str) -> DataFrame:
    """(key, parts): keys that stand in several parts; none if the parts are disjoint."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)


def compose(parts: DataFrame, setup: DataFrame) -> DataFrame:
    """(experiment, role, key): keys of the parts (part, key) that an experiment's setup (experiment, role, part) names, once each."""
    return parts.join(setup, "part").select("experiment", "role", "key").distinct()
