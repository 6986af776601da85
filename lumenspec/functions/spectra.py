"""Spectrum transforms. A spectrum is rows (spec_id, mz, intensity); keys may be several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("spec_id",)
TASK_ROWS = 1 << 18  # peaks of a task that sorts and sums whole spectra, about; few enough that small tables fill tasks as large ones do


def dealt(peaks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Spectra dealt to so many tasks that one holds about TASK_ROWS peaks, however well they compress: adaptive execution goes by bytes."""
    return peaks.repartition(max(peaks.sparkSession.sparkContext.defaultParallelism, -(-peaks.count() // TASK_ROWS)), *key)


def normalize(peaks: DataFrame, total: float = 100.0, key: Sequence[str] = KEY) -> DataFrame:
    """Scale each spectrum's intensities to the sum `total`; spectra without positive sum stay as they are."""
    s = F.sum("intensity").over(Window.partitionBy(*key))
    return peaks.withColumn("intensity", F.when(s > 0, F.col("intensity") * total / s).otherwise(F.col("intensity")))


def by_mass(peaks: Column) -> Column:
    """An array of peaks (mz, intensity) by rising m/z, equal ones by falling intensity."""
    key = F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), (-p["intensity"]).alias("_i")))
    return F.transform(F.array_sort(key), lambda p: F.struct(p["mz"].alias("mz"), (-p["_i"]).alias("intensity")))


def by_intensity(peaks: Column) -> Column:
    """An array of peaks (mz, intensity) by falling intensity, equal ones by rising m/z."""
    key = F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("_i"), p["mz"].alias("mz")))
    return F.transform(F.array_sort(key), lambda p: F.struct(p["mz"].alias("mz"), (-p["_i"]).alias("intensity")))


def scale_to_max(peaks: DataFrame, top: float = 100.0, key: Sequence[str] = KEY) -> DataFrame:
    """Scale each spectrum's highest intensity to `top`."""
    m = F.max("intensity").over(Window.partitionBy(*key))
    return peaks.withColumn("intensity", F.when(m > 0, F.col("intensity") * top / m).otherwise(F.col("intensity")))


def merge(peaks: DataFrame, bin_of: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Sum the intensities of a spectrum's peaks that share a bin, which becomes their m/z; then normalise."""
    return normalize(peaks.groupBy(*key, bin_of.alias("mz")).agg(F.sum("intensity").alias("intensity")), key=key)


def bin_integer(peaks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """m/z rounded half away from zero."""
    return merge(peaks, F.round("mz").cast("int"), key)


def quantise(peaks: DataFrame, digits: int, key: Sequence[str] = KEY) -> DataFrame:
    """m/z cut to trunc(mz 10^d + 0.5) / 10^d; spectra are normalised before."""
    p = float(10**digits)
    return normalize(dealt(peaks, key), key=key).groupBy(*key, (F.floor(F.col("mz") * p + 0.5) / p).alias("mz")).agg(F.sum("intensity").alias("intensity"))


def keep_most_intense(peaks: DataFrame, percent: float = 80, least: int = 5, most: int = 30, key: Sequence[str] = KEY) -> DataFrame:
    """By falling intensity, up to and including the first peak at which the running sum is above `percent` and more than
    `least` peaks are kept, or more than `most` are (P4). Ties go to the smaller m/z. Not normalised again."""
    w = Window.partitionBy(*key).orderBy(F.desc("intensity"), "mz")
    run, n = F.sum("intensity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w)
    stop = ((run > percent) & (n > least)) | (n > most)
    marked = peaks.withColumn("_n", n).withColumn("_stop", stop)
    first = F.min(F.when(F.col("_stop"), F.col("_n"))).over(Window.partitionBy(*key))
    return marked.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_n") <= F.col("_first"))).drop("_n", "_stop", "_first")


def postprocess(peaks: DataFrame, digits: int = 10, percent: float = 80, least: int = 5, most: int = 30, key: Sequence[str] = KEY) -> DataFrame:
    """Peaks of one mass merged at `digits` digits, the most intense kept, and these normalised (P5)."""
    return normalize(keep_most_intense(quantise(peaks, digits, key), percent, least, most, key), key=key)


def keep_above(peaks: DataFrame, share: float = 0.1, least: int = 5, key: Sequence[str] = KEY) -> DataFrame:
    """By falling intensity, up to and including the first peak below share * highest once `least` are kept."""
    w = Window.partitionBy(*key).orderBy(F.desc("intensity"), "mz")
    marked = peaks.withColumn("_n", F.row_number().over(w)).withColumn("_max", F.max("intensity").over(Window.partitionBy(*key)))
    marked = marked.withColumn("_first", F.min(F.when((F.col("intensity") < share * F.col("_max")) & (F.col("_n") >= least), F.col("_n"))).over(Window.partitionBy(*key)))
    return marked.where(F.col("_first").isNull() | (F.col("_n") <= F.col("_first"))).drop("_n", "_max", "_first")


def top_n(peaks: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """The n most intense peaks; ties go to the smaller m/z."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("intensity"), "mz"))
    return peaks.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def tolerance(mz: Column, absolute: float, ppm: float) -> Column:
    """max(absolute, mz ppm / 1e6)."""
    return F.greatest(F.lit(float(absolute)), mz * ppm / 1e6)


def clean(peaks: DataFrame, absolute: float, ppm: float, floor: float = 0.01, key: Sequence[str] = KEY) -> DataFrame:
    """Drop peaks below `floor` and peaks lower than their direct neighbour by m/z within tolerance."""
    w = Window.partitionBy(*key).orderBy("mz", "intensity")
    some = peaks.where(F.col("intensity") >= floor)
    tol = tolerance(F.col("mz"), absolute, ppm)
    beside = lambda f: (F.abs(F.col("mz") - f("mz").over(w)) <= tol) & (F.col("intensity") < f("intensity").over(w))
    return some.withColumn("_low", F.coalesce(beside(F.lag), F.lit(False)) | F.coalesce(beside(F.lead), F.lit(False))).where(~F.col("_low")).drop("_low")


def near_masses(peaks: DataFrame, masses: DataFrame, absolute: float, ppm: float, width: float = 1.0) -> DataFrame:
    """Peaks within tolerance (strictly) of a mass of their spectrum (P9): a bucketed semi-join; width is at least the tolerance."""
    m = masses.select(F.col("spec_id").alias("_spec"), F.col("mass").alias("_mass"), F.explode(F.array(*[F.floor(F.col("mass") / width) + k for k in (-1, 0, 1)])).alias("_cell"))
    near = (F.col("spec_id") == F.col("_spec")) & (F.floor(F.col("mz") / width) == F.col("_cell")) & (F.abs(F.col("mz") - F.col("_mass")) < tolerance(F.col("mz"), absolute, ppm))
    return peaks.join(m, near, "left_semi")


def dense(peaks: DataFrame, bins: int, key: Sequence[str] = KEY, order: str = "pos") -> DataFrame:
    """(key, vec): array of `bins` values by m/z rounded half to even; the last row (by `order`) of a bin wins; divided by the highest + 1e-6."""
    at = F.bround("mz").cast("int")
    cells = peaks.where((at >= 0) & (at < bins)).groupBy(*key, at.alias("_bin")).agg(F.max_by("intensity", order).alias("_v"))
    vec = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_v"))).alias("_m"), F.max("_v").alias("_max"))
    filled = lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)) / (F.col("_max") + 1e-6))
    return vec.select(*key, F.transform(F.array("_m"), filled)[0].alias("vec"))  # bound once: the plan would build the map anew for each bin


def sparse(vectors: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, mz, intensity) of the positive cells of dense vectors."""
    return vectors.select(*key, F.posexplode("vec").alias("mz", "intensity")).where("intensity > 0")


def unit_weighted(vec: Column, power: float = 1.0) -> Column:
    """Vector times weights (1..n)^power / their sum, scaled to length 1 (P20); a zero vector stays zero."""
    w = F.transform(vec, lambda x, i: x * F.pow((i + 1).cast("double"), F.lit(power)))
    norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(w, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(x, norm)))


def bits_of(vec: Column) -> Column:
    """'0'/'1' string of the signs of a vector."""
    return F.concat_ws("", F.transform(vec, lambda x: F.when(x > 0, "1").otherwise("0")))


def set_bits(bits: Column) -> Column:
    """Places of the ones of a bit string."""
    return F.filter(F.transform(F.split(bits, ""), lambda c, i: F.when(c == "1", i)), lambda x: x.isNotNull())
