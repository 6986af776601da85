"""A corpus pipeline over `documents`: language ID, toxicity, near duplicates, mixing, packing.

Each stage works on all that its predecessor kept, and is written before the next one reads it. An empty table gives an
empty one in every stage. Null, empty and blank texts have no language, so the first stage drops them; by themselves the
others keep them: not toxic, near no other, in the mix repeated like others of their source, one closing id in packing. Repeated rows
are rows of their own until the near-copy stage, which keeps one. Null ids, languages and sources are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.llm import jaccard, language, mixing, packing, tokens, toxicity
from lumenspec.llm.common import as_table
from lumenspec.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL can train the two models. Tests hold each operator against brute force, and run every stage on edge rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages."""
    ship(spark)
    return language.keep_languages(docs.select(*COLUMNS))


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the network learns from the labelled ones among all documents."""
    ship(spark)
    net = toxicity.fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), net).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the join links."""
    ship(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    mix = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mix.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokens.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("toxicity", clean_of_toxicity),
    ("ngram_jaccard", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = as_table(docs)
    return docs
