"""Peaks with annotations, fragment masses and fragment graphs, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.tables import written


def scale_annotations(rows: DataFrame, peak: Sequence[str] = ("spec_id", "mz"), frag: str = "frag") -> DataFrame:
    """Annotations (peak, intensity, frag, score) of a peak scaled to sum to intensity / 100, with their place by falling score (P10). Scores
    may be decimals, whose sum does not depend on the order of rows."""
    s = F.sum("score").over(Window.partitionBy(*peak))
    place = F.row_number().over(Window.partitionBy(*peak).orderBy(F.desc("score"), frag))
    return rows.withColumn("place", place).withColumn("score", F.when(s > 0, F.col("score").cast("double") * F.col("intensity") / 100 / s.cast("double")).otherwise(F.lit(0.0)))


def merge_exact(rows: DataFrame, key: Sequence[str] = ("spec_id",), frag: str = "frag") -> DataFrame:
    """(key, mz, intensity, frags): contributions of one exact mass summed, with their sorted annotations."""
    return rows.groupBy(*key, "mz").agg(F.sum("intensity").alias("intensity"), F.array_sort(F.collect_list(frag)).alias("frags"))


def distinct_masses(rows: DataFrame, gap: float = 1e-10, key: Sequence[str] = ("spec_id",), mz: str = "mz") -> DataFrame:
    """Sorted masses of each key without those within `gap` of the one before."""
    before = F.lag(mz).over(Window.partitionBy(*key).orderBy(mz))
    return rows.select(*key, mz).distinct().withColumn("_before", before).where(F.col("_before").isNull() | (F.col(mz) - F.col("_before") > gap)).drop("_before")


def uniform_spectrum(rows: DataFrame, gap: float = 1e-10, key: Sequence[str] = ("spec_id",)) -> DataFrame:
    """(key, mz, intensity): each possible mass once, at height 100 / n."""
    return distinct_masses(rows, gap, key).withColumn("intensity", F.lit(100.0) / F.count("*").over(Window.partitionBy(*key)))


def gaussian_weights(peaks: DataFrame, fragments: DataFrame, tolerance: float, share: float = 0.33) -> DataFrame:
    """(spec_id, mz, frag, weight) of peaks and fragments (spec_id, frag, mass) within three deviations (share * tolerance),
    by a Gaussian of the distance, weights of a peak summing to 1 (J14). An equi-join on cells of that width."""
    sigma = share * tolerance
    reach = 3 * sigma
    cells = F.explode(F.array(*[F.floor(F.col("mass") / reach) + k for k in (-1, 0, 1)]))
    f = fragments.select(F.col("spec_id").alias("_spec"), "frag", "mass").withColumn("_cell", cells)
    near = peaks.join(f, (F.col("spec_id") == F.col("_spec")) & (F.floor(F.col("mz") / reach) == F.col("_cell")) & (F.abs(F.col("mz") - F.col("mass")) <= reach))
    z = (F.col("mz") - F.col("mass")) / sigma
    rows = near.select("spec_id", "mz", "frag", F.exp(-z * z / 2).alias("weight"))
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("spec_id", "mz")))


def depths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(mol, node, depth): fewest steps from the nodes of `start` (mol, node) over edges (mol, src, dst), up to `most`.
    A node also steps to itself, at no cost, so a round is one join and one minimum."""
    loops = edges.select("mol", F.col("src").alias("node")).unionByName(edges.select("mol", F.col("dst").alias("node"))).unionByName(start.select("mol", "node")).distinct()
    steps = edges.select("mol", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct().withColumn("_cost", F.lit(1))
    steps = steps.unionByName(loops.select("mol", "node", F.col("node").alias("_to"), F.lit(0).alias("_cost")))
    reached = start.select("mol", "node").distinct().withColumn("depth", F.lit(0))
    for _ in range(most):
        reached = reached.join(steps, ["mol", "node"]).groupBy("mol", F.col("_to").alias("node")).agg(F.min(F.col("depth") + F.col("_cost")).alias("depth"))
    return reached


def without_detours(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Edges whose source is less deep than their end."""
    at = lambda end: depth.select("mol", F.col("node").alias(end), F.col("depth").alias(f"_{end}"))
    return edges.join(at("src"), ["mol", "src"]).join(at("dst"), ["mol", "dst"]).where("_src < _dst").drop("_src", "_dst")


def evidence(edges: DataFrame, belief: DataFrame, least: float, keep: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges between nodes of at least this belief (mol, node, belief), less dead ends: nodes without edges out that are
    not in `keep` (mol, node), taken away again and again until none is left (I11). Each round is written; an error if `rounds` are not enough."""
    sure = written(belief.where(F.col("belief") >= least).select("mol", "node"))
    keep = written(keep.select("mol", "node").distinct())
    now = edges.join(sure.withColumnRenamed("node", "src"), ["mol", "src"], "left_semi").join(sure.withColumnRenamed("node", "dst"), ["mol", "dst"], "left_semi")
    now = written(now.select(*edges.columns))
    n = now.count()
    for _ in range(rounds):
        alive = now.select("mol", F.col("src").alias("dst")).unionByName(keep.withColumnRenamed("node", "dst")).distinct()
        now = written(now.join(alive, ["mol", "dst"], "left_semi").select(*edges.columns))
        left = now.count()
        if left == n:
            return now
        n = left
    raise RuntimeError(f"dead ends are left after {rounds} rounds")
