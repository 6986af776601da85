"""The test tables as spectra: the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.functions.spectra import bits_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    mz = F.col("l_partkey") % 500 + (F.col("l_suppkey") % 10) / F.lit(10.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spec_id"), mz.cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity"), *more)


def spec_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_id"), (F.col("o_totalprice").cast("double") / 1000).alias("mass"), F.col("o_orderpriority").alias("cls"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"), bits_of(F.col("embedding")).alias("bits"))


def bit_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries (query, vec) and all vectors (lib, vec), as 0/1 arrays of their signs."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("double")).alias("vec"))
    return v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query"), v.withColumnRenamed("vec_id", "lib")


#: Common table expressions for the SQL side.
SQL = {
    "peaks": "peaks AS (SELECT l_orderkey AS spec_id, (l_partkey % 500 + (l_suppkey % 10) / 10.0::DOUBLE)::DOUBLE AS mz, l_quantity::DOUBLE AS intensity FROM lineitem)",
    "norm": "norm AS (SELECT spec_id, mz, intensity * 100.0::DOUBLE / sum(intensity) OVER (PARTITION BY spec_id) AS intensity FROM peaks)",
    "merged": "merged AS (SELECT spec_id, round(mz)::INT AS mz, sum(intensity) AS intensity FROM peaks GROUP BY ALL)",
    "bins": "bins AS (SELECT spec_id, mz, intensity * 100.0::DOUBLE / sum(intensity) OVER (PARTITION BY spec_id) AS intensity FROM merged)",
    "meta": "meta AS (SELECT o_orderkey AS spec_id, o_totalprice::DOUBLE / 1000 AS mass, o_orderpriority AS cls FROM orders)",
    "vecs": "vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS vec, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
