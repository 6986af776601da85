"""Text records of spectra and results, as columns and rows of lines."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def significant(x: Column, digits: int = 10) -> Column:
    """A number in `digits` significant digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}g", x.cast("double"))
    return F.when(x == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"))


def peak_line(p: Column) -> Column:
    return F.concat_ws(" ", significant(p["mz"]), significant(p["intensity"]))


def peak_lines(peaks: Column) -> Column:
    """Lines "m/z intensity" of an array of peaks, in 10 significant digits (K1)."""
    return F.array_join(F.transform(peaks, peak_line), "\n")


def annotated_lines(peaks: Column) -> Column:
    """The same with each peak's fragments and, in brackets, their scores in percent; peaks (mz, intensity, notes (frag, score)) (K1)."""
    notes = lambda p: F.concat(F.lit(" "), F.array_join(F.transform(p["notes"], lambda a: a["frag"].cast("string")), " "), F.lit(" ("), F.array_join(F.transform(p["notes"], lambda a: F.format_string("%.5g", a["score"] * 100)), " "), F.lit(")"))
    return F.array_join(F.transform(peaks, lambda p: F.concat(peak_line(p), F.when(F.size(p["notes"]) > 0, notes(p)).otherwise(""))), "\n")


def mgf_record(name: Column, energy: Column, mass: Column, peaks: Column, charge: str = "1+", kind: str = "[M]+;") -> Column:
    """An MGF record (K3)."""
    return F.concat(F.lit("BEGIN IONS\nPEPMASS="), mass.cast("string"), F.lit(f"\nCHARGE={charge}\nTITLE="), name, F.lit(";Energy"), energy.cast("string"), F.lit(f";{kind}\n"), peak_lines(peaks), F.lit("\nEND IONS"))


def candidate_lines(ranked: DataFrame, per_line: int = 5) -> DataFrame:
    """(analyte, line, text): ranked candidates (analyte, rank, lib, score) as "score: lib; ", `per_line` to a line."""
    piece = F.concat(F.format_string("%.6f", F.col("score")), F.lit(": "), F.col("lib").cast("string"), F.lit("; "))
    line = F.floor((F.col("rank") - 1) / per_line)
    rows = ranked.groupBy("analyte", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))).alias("_p"))
    return rows.select("analyte", "line", F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("text"))


def write_candidates(ranked: DataFrame, path: str) -> None:
    """Blocks of an analyte's id, its candidates' lines and an empty line."""
    lines = candidate_lines(ranked).groupBy("analyte").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    text = F.concat(F.col("analyte").cast("string"), F.lit("\n"), F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), F.lit("\n"))
    lines.select(text.alias("value")).write.text(path)


def answer_line(query: Column, rank: Column, score: Column) -> Column:
    """"query:rank,score" (K12)."""
    return F.concat(query.cast("string"), F.lit(":"), rank.cast("string"), F.lit(","), F.format_string("%.6f", score))


def score_line(query: Column, *scores: Column) -> Column:
    """"query:score;score;..." (K12)."""
    return F.concat(query.cast("string"), F.lit(":"), F.concat_ws(";", *[F.format_string("%.6f", s) for s in scores]))


def ranked_line(rank: Column, score: Column, lib: Column, structure: Column) -> Column:
    """"rank score id structure" (K13)."""
    return F.concat_ws(" ", rank.cast("string"), F.format_string("%.8g", score), lib.cast("string"), structure)


def write_counts(rows: DataFrame, by: str, path: str) -> None:
    """Tab-separated counts of a column's values."""
    rows.groupBy(by).agg(F.count("*").alias("n")).write.csv(path, sep="\t")


def insert_ignore(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`table` with the rows whose key it lacks, one a key."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def sdf_block(name: Column, props: Column, atoms: Column | None = None, bonds: Column | None = None) -> Column:
    """A molecule block with its properties, and with atoms (x, y, z, symbol) and bonds (a, b, order) where they are given (K7); read_sdf reads it back."""
    if atoms is not None:
        atom = lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", a["x"], a["y"], a["z"], a["symbol"])
        bond = lambda b: F.format_string("%3d%3d%3d  0", b["a"], b["b"], b["order"])
        bonds = bonds if bonds is not None else F.array().cast("array<struct<a:int,b:int,order:int>>")
        counts = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size(atoms), F.size(bonds))
        body = F.concat(counts, F.lit("\n"), F.array_join(F.concat(F.transform(atoms, atom), F.transform(bonds, bond), F.array(F.lit("M  END"))), "\n"), F.lit("\n"))
    else:
        body = F.lit("  0  0  0  0  0  0  0  0  0  0999 V2000\nM  END\n")
    fields = F.transform(F.map_entries(props), lambda x: F.concat(F.lit(">  <"), x["key"], F.lit(">\n"), x["value"], F.lit("\n")))
    return F.concat(name, F.lit("\n\n\n"), body, F.array_join(fields, "\n"), F.lit("\n$$$$"))


def peak_pair_lines(pairs: Column) -> Column:
    """Lines "m/z intensity m/z intensity" of matched peaks (p, q), for a scatter log."""
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws(" ", peak_line(x["p"]), peak_line(x["q"]))), "\n")


def fragment_line(frag: Column, mass: Column, structure: Column) -> Column:
    """"id mass structure" (K16)."""
    return F.concat_ws(" ", frag.cast("string"), significant(mass), structure)


def transition_line(src: Column, dst: Column, loss: Column) -> Column:
    """"from to loss" (K16)."""
    return F.concat_ws(" ", src.cast("string"), dst.cast("string"), loss)


def graph_lines(fragments: DataFrame, transitions: DataFrame, belief: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(mol, part, place, text) of a molecule's graph: how many fragments, a line each, an empty line, a line a transition.

    fragments are (mol, frag, mass, structure), transitions (mol, src, dst, loss). With belief (mol, frag, belief) only
    fragments of at least `least` and transitions between them stand, each fragment's belief at its line's end.
    """
    f = fragments.select("mol", "frag", "mass", "structure", F.lit(None).cast("double").alias("belief"))
    if belief is not None:
        f = f.drop("belief").join(belief.where(F.col("belief") >= least), ["mol", "frag"])
        ends = f.select("mol", "frag")
        transitions = transitions.join(ends.withColumnRenamed("frag", "src"), ["mol", "src"], "left_semi").join(ends.withColumnRenamed("frag", "dst"), ["mol", "dst"], "left_semi")
    count = f.groupBy("mol").agg(F.count("*").cast("string").alias("text"))
    empty = f.select("mol").distinct().withColumn("text", F.lit(""))
    lines = f.select("mol", F.col("frag").alias("place"), F.concat_ws(" ", fragment_line(F.col("frag"), F.col("mass"), F.col("structure")), F.when(F.col("belief").isNotNull(), significant(F.col("belief")))).alias("text"))
    moves = transitions.select("mol", F.row_number().over(Window.partitionBy("mol").orderBy("src", "dst")).cast("long").alias("place"), transition_line(F.col("src"), F.col("dst"), F.col("loss")).alias("text"))
    parts = [count.withColumn("place", F.lit(0)), lines, empty.withColumn("place", F.lit(0)), moves]
    return functools.reduce(DataFrame.unionByName, [p.select("mol", F.lit(k).alias("part"), F.col("place").cast("long").alias("place"), "text") for k, p in enumerate(parts)])


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One text a line, appended to what the folder holds: candidate structures (K9), match logs."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def match_line(truth: Column, guess: Column, rank: Column) -> Column:
    """"true predicted rank" (K19)."""
    return F.concat_ws(" ", truth, guess, rank.cast("string"))


def write_fingerprints(rows: DataFrame, path: str) -> None:
    """CSV of smiles and fingerprint, with a header."""
    rows.select("smiles", "fingerprint").write.option("header", True).csv(path)


def read_bit_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated result file of bit models."""
    return spark.read.csv(path, sep="\t", schema="id int, accuracy double, precision double, recall double, f1 double")
