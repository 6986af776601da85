"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every document has a 36-bit hash of its id. A source that is to give `target` words takes each of its documents
floor(target / size) times, and once more those documents whose hash is below a threshold. The threshold comes from
nested histograms: words by (source, top 12 bits), then by the next 12 bits inside the one bucket in which the budget
ends, then by the last 12 bits. Nothing is sorted, and only sums by bucket are shuffled, so a hot source costs no more
than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

LEVEL_BITS, LEVELS = 12, 3
WIDTH = 1 << LEVEL_BITS
OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(key: Column, seed: str = "") -> Column:
    """36 bits of md5(seed + key as text); a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most_repeats: float = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code-point order, null last, take the weights in turn. The budget (default: all words) is shared by weight;
    a target stops at most_repeats times its source and the rest is shared again, until none is above: the water level
    is the first, in order of cap / weight, that its source's cap reaches.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most_repeats))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(whole).cast("double")
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_at", F.row_number().over(by_ratio))
    s = s.withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_at", "_level"))).over(whole))
    return s.select("source", "source_size", F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_first._level") * F.col("_w"))).alias("target"))


def _refine(hashes: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """Words by bucket inside the bucket where each source's budget ends (at the top: everywhere), and where it ends now."""
    shift, last = LEVEL_BITS * (LEVELS - 1 - level), level == LEVELS - 1
    own = F.col("source").eqNullSafe(F.col("_s"))
    if level:
        hashes = hashes.join(plan.select(F.col("source").alias("_s"), "_from"), own & (F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("_from", shift + LEVEL_BITS)))
    sums = hashes.groupBy("source", F.shiftright("hash", shift).alias("_b")).agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_sum", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")))
    sums = sums.join(plan.select(F.col("source").alias("_s"), "_rest"), own)
    fits = (2 * F.col("_sum") - F.col("_n") <= 2 * F.col("_rest")) if last else (F.col("_sum") <= F.col("_rest"))
    found = sums.groupBy("_s").agg(F.min(F.when(~fits, F.col("_b"))).alias("_e"), F.max("_b").alias("_top"), F.max(F.when(fits, F.col("_sum"))).alias("_u"))
    edge = F.coalesce(F.col("_e"), F.col("_top") + int(last))  # all fit only where a source has no words
    found = found.select("_s", F.shiftleft(edge, shift).alias("_edge"), F.when(F.col("_e").isNotNull(), F.col("_u")).alias("_used"))
    return plan.join(found, own, "left").select("source", "source_size", "target", "_copies", F.coalesce("_edge", "_from").alias("_from"), (F.col("_rest") - F.coalesce("_used", F.lit(0))).alias("_rest"))


def mix_plan(hashes: DataFrame, weights: Sequence[float] = (5, 2, 1), most_repeats: float = 3, budget: int | None = None) -> DataFrame:
    """(source, size, hash) of all documents -> one row a source: source_size, target, whole copies of each document, hash threshold of one more."""
    sizes = hashes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most_repeats, budget)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = as_table(plan.withColumn("_copies", copies).withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size")).withColumn("_from", F.lit(0).cast("long")))
    for level in range(LEVELS):
        plan = as_table(_refine(hashes, plan, level))
    return plan.select("source", "source_size", "target", "_copies", F.col("_from").alias("_threshold"))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), most_repeats: float = 3, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """The rows of `df` with size, source_size, target (its source's), copies and taken = size * copies.

    Null text counts 0 words; a null source is a source of its own; an empty table gives an empty table; repeated rows
    share an id's hash, so they are taken together; a column of `df` with the name of an output column gives way.
    """
    keep = [c for c in df.columns if c not in OUT]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), id_hash(F.col(id_col), seed).alias("hash"))
    plan = mix_plan(as_table(row.select("source", "size", "hash")), weights, most_repeats, budget)
    joined = row.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    joined = joined.withColumn("copies", F.col("_copies") + (F.col("hash") < F.col("_threshold")).cast("long"))
    return joined.select("_row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size::DOUBLE * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER r AS nth,
             ((SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW r AS (ORDER BY cap / w, source IS NULL, source)),
f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * w), cap) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
h AS (SELECT source, hash, sum(size)::BIGINT AS n FROM d GROUP BY source, hash),
k AS (SELECT h.source, h.hash, 2 * sum(n) OVER (PARTITION BY h.source ORDER BY h.hash) - n <= 2 * (c.target - c.copies * c.source_size) AS more
      FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, c.source_size, c.target, d.size * (c.copies + k.more::BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.hash = k.hash
"""
