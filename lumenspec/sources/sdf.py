"""Molecule blocks (SDF) as rows: atoms, bonds and properties, a reader that sets bad blocks aside, and lists of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.sources.msp import dense_spectra, peaks_of, split_records
from lumenspec.tables import shared_path

PEAKS, STRUCTURE, MASS, PREDICTED = "MASS SPECTRAL PEAKS", "SMILES", "EXACT MASS", "PREDICTED SPECTRUM"


def _integer(line: Column, start: int) -> Column:
    return F.trim(F.substring(line, start, 3)).try_cast("int")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """name, atoms (x, y, z, symbol), bonds (a, b from 1, order), props of each molecule block, of any size and line ends.

    atoms and bonds are null where the block has no counts line, or fewer or other lines than it says. A property's
    value runs to an empty line, the next property or the block's end; of a repeated property the last counts.
    """
    rows = split_records(spark, path, "$$$$").where("trim(regexp_replace(value, '[\\n\\r]', '')) <> ''")
    rows = rows.withColumn("_lines", F.split("value", "\n")).withColumn("_n", _integer(F.get("_lines", F.lit(3)), 1)).withColumn("_m", _integer(F.get("_lines", F.lit(3)), 4))
    part = lambda start, n: F.slice("_lines", start, n)
    words = F.transform(part(F.lit(5), F.col("_n")), lambda x: F.split(F.trim(x), r"\s+"))
    number = lambda w, k: F.get(w, F.lit(k)).try_cast("double")
    atoms = F.transform(words, lambda w: F.struct(number(w, 0).alias("x"), number(w, 1).alias("y"), number(w, 2).alias("z"), F.get(w, F.lit(3)).alias("symbol")))
    bonds = F.transform(part(5 + F.col("_n"), F.col("_m")), lambda x: F.struct(_integer(x, 1).alias("a"), _integer(x, 4).alias("b"), _integer(x, 7).alias("order")))
    fine = (F.col("_n") >= 0) & (F.col("_m") >= 0) & (F.size("_lines") >= 4 + F.col("_n") + F.col("_m"))
    fine = fine & F.forall(atoms, lambda a: a["symbol"].isNotNull() & a["z"].isNotNull()) & F.forall(bonds, lambda b: b["order"].isNotNull() & b["a"].between(1, F.col("_n")) & b["b"].between(1, F.col("_n")))
    keys = F.regexp_extract_all("value", F.lit(r"(?m)^> *<([^>]+)>"), 1)
    values = F.transform(F.regexp_extract_all("value", F.lit(r"(?ms)^> *<[^>]+>[^\n]*\n(.*?)(?=\n\n|\n> *<|\s*\z)"), 1), lambda x: F.trim(x))
    last = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"]))
    props = F.map_from_entries(F.transform(F.array(F.arrays_zip(keys.alias("k"), values.alias("v"))), last)[0])
    known = F.coalesce(fine, F.lit(False))
    return rows.select(F.trim(F.col("_lines")[0]).alias("name"), F.when(known, atoms).alias("atoms"), F.when(known, bonds).alias("bonds"), props.alias("props"))


def bond_rows(molecules: DataFrame, key: str = "name") -> DataFrame:
    """(key, a, b, order): a row a bond."""
    return molecules.select(key, F.explode("bonds").alias("bond")).select(key, "bond.*")


def sorted_out(molecules: DataFrame, max_atoms: int = 100, max_ratio: float = 3.0, max_mz: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of molecule blocks, in one pass: each block is written once, with the first reason against it.

    Both have the columns of `molecules` and peaks, structure, mass; rejected has a reason: unparsable, too many atoms, no
    peaks, no structure, no mass, last peak over mass (their ratio is max_ratio or more), last peak too high (max_mz or more).
    """
    prop = lambda name: F.nullif(F.trim(F.col("props")[name]), F.lit(""))
    rows = molecules.select("*", peaks_of(F.coalesce(F.col("props")[PEAKS], F.lit(""))).alias("peaks"), prop(STRUCTURE).alias("structure"), prop(MASS).try_cast("double").alias("mass"))
    last = F.array_max(F.transform("peaks", lambda p: p["mz"]))
    rules = [
        ("unparsable", F.col("atoms").isNull()), ("too many atoms", F.size("atoms") > max_atoms), ("no peaks", F.size("peaks") == 0), ("no structure", F.col("structure").isNull()),
        ("no mass", F.coalesce(F.col("mass"), F.lit(0.0)) <= 0), ("last peak over mass", last / F.col("mass") >= max_ratio), ("last peak too high", last >= max_mz),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    rows = rows.withColumn("reason", reason).withColumn("rejected", F.col("reason").isNotNull())
    path = shared_path(rows.sparkSession, "blocks")
    rows.write.partitionBy("rejected").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return back.where("not rejected").drop("rejected", "reason"), back.where("rejected").drop("rejected")


def library_of(molecules: DataFrame, predicted: bool = False) -> DataFrame:
    """Records for write_msp from blocks with properties: name and id are the structure, mw the exact mass, peaks the measured or the predicted ones (K6)."""
    prop = lambda name: F.col("props")[name]
    peaks = peaks_of(F.coalesce(prop(PREDICTED if predicted else PEAKS), F.lit("")))
    return molecules.select(prop(STRUCTURE).alias("name"), prop(STRUCTURE).alias("id"), F.lit(0).alias("energy"), prop(MASS).alias("mw"), F.lit(None).cast("string").alias("fp"), peaks.alias("peaks"))


def dense_of(molecules: DataFrame, predicted: bool = False, bins: int = 2000) -> DataFrame:
    """(id, structure, vec) of blocks: the dense vector of their measured or predicted peaks, the last of equal m/z counting."""
    text = F.coalesce(F.col("props")[PREDICTED if predicted else PEAKS], F.lit(""))
    rows = molecules.select("name", F.col("name").alias("id"), F.create_map(F.lit("SMILES"), F.col("props")[STRUCTURE]).alias("params"), peaks_of(text, ordered=False).alias("peaks"))
    return dense_spectra(rows, bins)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(structure) of a list with one a line; a file ends at its first blank line."""
    lines = spark.read.text(path).select(F.trim("value").alias("structure"), F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    ends = lines.where("structure = ''").groupBy("_file").agg(F.min("_at").alias("_end"))
    return lines.join(ends, "_file", "left").where("_end is null or _at < _end").select("structure")


def read_dense_csv(spark: SparkSession, path: str, bins: int = 1000) -> DataFrame:
    """(structure, vec) of lines with a structure and the intensity at m/z 1, 2, ... (S16); a cell that is no number is an error, an absent one 0."""
    rows = spark.read.csv(path, schema=", ".join(["structure string", *[f"c{k} string" for k in range(1, bins)]]), enforceSchema=True)
    cell = lambda k: F.coalesce(F.col(f"c{k}").cast("double"), F.lit(0.0))
    return rows.select("structure", F.array(F.lit(0.0), *[cell(k) for k in range(1, bins)]).alias("vec"))
