"""The detection search: analytes against a library, by spectrum and fingerprint, within a mass window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.operators.search import search_all


def filter_peaks(peaks: DataFrame, least_share: float = 0.05, first: int = 10, key: str = "spec_id") -> DataFrame:
    """The `first` most intense peaks (ties to the smaller m/z), and any above least_share of the sum; the sum is of whole
    numbers, cut at every addition by falling intensity, as is done where it is an integer (P13)."""
    order = Window.partitionBy(key).orderBy(F.desc("intensity"), "mz")
    total = F.sum(F.floor("intensity")).over(Window.partitionBy(key))
    return peaks.withColumn("_n", F.row_number().over(order)).withColumn("_sum", total).where((F.col("_n") <= first) | (F.col("intensity") > least_share * F.col("_sum"))).drop("_n", "_sum")


def search(analytes: DataFrame, library: DataFrame, masses: DataFrame, bits: DataFrame, width: float = 1.0, top_n: int = 10, k: int = 100) -> DataFrame:
    """(analyte, rank, lib, score): the k best library spectra within `width` of each analyte's mass, ties to the smaller lib.

    The score is 0.7 sqrt(A1 A11) + 0.3 fingerprint Jaccard, the first alone where a fingerprint is missing; without
    top_n it has A1 in place of the root (J1, F1, A12, W1). Spectra are rows (spec_id, mz, intensity), masses (spec_id,
    mass), bits (spec_id, set: places of the ones). Spectra meet by cells of masses, which give back their best, never
    the pairs of a window.
    """
    return search_all(analytes, library, bits, k, top_n, masses=masses, width=width)
