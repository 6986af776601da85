"""Text libraries of spectra as DataFrames, and back: MSP records, peak lists, SDF property blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.sources.msp import peaks_of, read_msp, write_msp
from lumenspec.sources.sdf import read_sdf

__all__ = ["read_msp", "write_msp", "read_peak_lists", "read_sdf", "read_pairs", "read_library", "spectra_of", "READERS"]

def read_peak_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, energy (0-based number of the header low/med/high/energyN), peaks (S5); a file without header is one spectrum."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    marked = F.regexp_replace("value", r"(?m)^(low|med|high|energy\w*)[ \t\r]*$", "\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")
    return files.select("file", F.posexplode(parts).alias("energy", "t")).select("file", "energy", peaks_of(F.col("t")).alias("peaks"))


def read_pairs(spark: SparkSession, path: str, columns: str = "id string, smiles string, grp int") -> DataFrame:
    """Space-separated lists: molecules, candidates, name-value settings."""
    return spark.read.csv(path, sep=" ", schema=columns, comment="#")


def read_listed(spark: SparkSession, path: str, columns: str = "id string, smiles string, grp int") -> DataFrame:
    """A list whose first line may say how many lines follow: the rows, of lines with at least two fields (S19, S20). Another number of rows than it says is an error."""
    rows = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> '' and value not like '#%'")
    said = [int(r[0]) for r in rows.where(r"value rlike '^\\d+$'").select("value").limit(2).collect()]
    names = [c.split() for c in columns.split(", ")]
    fields = F.split("value", r"\s+")
    found = rows.where(F.size(fields) > 1).select(*[F.get(fields, F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(names)])
    if len(said) > 1 or said and found.count() != said[0]:
        raise ValueError(f"{path} says {said} lines and has {found.count()}")
    return found


def read_settings(spark: SparkSession, path: str, defaults: dict[str, str] | None = None, lists: tuple[str, ...] = ()) -> dict[str, str | list[str]]:
    """Settings, a name and a value a line, over the defaults: of a name that stands again the last value, or all in order for those in `lists`.
    Files of settings are small and are read by the driver."""
    out: dict = dict(defaults or {}) | {name: [] for name in lists}
    for r in spark.read.text(path, wholetext=True).collect():
        for line in r["value"].splitlines():
            name, _, value = line.strip().partition(" ")
            if value and not name.startswith("#"):
                out[name] = [*out[name], value.strip()] if name in lists else value.strip()
    return out


def spectra_of(library: DataFrame, id: str) -> DataFrame:
    """The records of one id; an id that the library lacks is an error."""
    found = library.where(F.col("id") == id)
    if not found.take(1):
        raise KeyError(id)
    return found


READERS = {".msp": read_msp, ".sdf": read_sdf}


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the suffix names: .msp exactly, .sdf in any case; another suffix is an error."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1]
    for known, read in READERS.items():
        if suffix == known or known == ".sdf" and suffix.lower() == known:
            return read(spark, path)
    raise ValueError(f"no reader for {path}")
