"""Keys, unions, flags and filters of tables of molecules and spectra, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand more than once."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def maxima(rows: DataFrame, **columns: str) -> DataFrame:
    """One row: the highest value of each column, under the names given."""
    return rows.agg(*[F.max(c).alias(name) for name, c in columns.items()])


def counts_by(rows: DataFrame, by: str, name: str = "reason") -> DataFrame:
    """(name, n): rows of each value of a column."""
    return rows.groupBy(F.col(by).alias(name)).agg(F.count("*").alias("n"))


def balanced_bits(bits: DataFrame, least: float = 0.1, most: float = 0.9) -> DataFrame:
    """(bit, share): places of bit strings `bits` that are set in a share of the rows between the two, inclusive."""
    each = bits.select(F.posexplode(F.split("bits", "")).alias("bit", "b"))
    return each.groupBy(F.col("bit").cast("long").alias("bit")).agg(F.avg(F.col("b").cast("int")).alias("share")).where(F.col("share").between(least, most))


def merge_first(rows: DataFrame, table: DataFrame, key: str, other: str, order: Sequence[str] = ()) -> DataFrame:
    """`rows` with the columns of the first row of `table` that has their key, null where none has (J4). Rows of one key go
    by the columns `order`, then by all columns, so the same one is taken on every run."""
    by = [*order, *[c for c, kind in table.dtypes if c not in order and c != other and "map" not in kind]]
    first = table.groupBy(other).agg(F.min_by(F.struct(*[c for c in table.columns if c != other]), F.struct(*by)).alias("_row")) if by else table.select(other).distinct()
    first = first.select(other, "_row.*") if by else first
    return rows.join(first, F.col(key) == F.col(other), "left")


def exclude(rows: DataFrame, key: str, held_out: DataFrame, other: str) -> DataFrame:
    """Rows whose key is not held out: other groups than the test group, molecules not trained on."""
    return rows.join(held_out.select(F.col(other).alias("_out")), F.col(key) == F.col("_out"), "left_anti")


def flag_known(rows: DataFrame, key: str, known: DataFrame, other: str, name: str = "known") -> DataFrame:
    """`rows` with a boolean: does the key stand in the other table."""
    keys = known.select(F.col(other).alias("_known")).where("_known is not null").distinct()
    return rows.join(keys, F.col(key) == F.col("_known"), "left").withColumn(name, F.col("_known").isNotNull()).drop("_known")


def union_with_origin(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("predicted", "measured")) -> DataFrame:
    """Rows of both libraries with a column origin; columns that one lacks are null there (U1, U2). Order by origin_rank
    (0: the first) puts the first library's rows in front."""
    parts = [d.withColumn("origin", F.lit(n)).withColumn("origin_rank", F.lit(k)) for k, (d, n) in enumerate(zip((first, second), names))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def paired(measured: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("id", "energy")) -> DataFrame:
    """(keys, p, q): spectra (keys, peaks) that stand in both tables; a missing prediction drops the row."""
    return measured.select(*keys, F.col("peaks").alias("p")).join(predicted.select(*keys, F.col("peaks").alias("q")), list(keys))


def members_by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, members): the sorted values of each key; `flattened` undoes it (A27). For keys whose values fit a row."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("members"))


def flattened(lists: DataFrame, key: str, value: str) -> DataFrame:
    return lists.select(key, F.explode("members").alias(value))


def every_nth(rows: DataFrame, index: str, n: int) -> DataFrame:
    """Rows whose index (a column of row numbers from 0) is divisible by n."""
    return rows.where(F.col(index) % n == 0)


def without_id(rows: DataFrame, name: str = "CC", key: str = "id") -> DataFrame:
    """Records but those of exactly this id; a record is a row, so its lines go with it."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(name)))


def property_contains(prop: Column, text: str) -> Column:
    """Does the property hold the text; a missing one does not (F4). Negate for "not contains"."""
    return F.coalesce(F.contains(prop, F.lit(text)), F.lit(False))


def usable_models(metrics: DataFrame, least: float = 0.5) -> DataFrame:
    """Models whose f1 is above `least` (F8)."""
    return metrics.where(F.col("f1") > least)


def without_nan(rows: DataFrame, *targets: str) -> DataFrame:
    """Rows that have a number in every target column."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in targets]
    return rows.where(ok[0] if len(ok) == 1 else F.forall(F.array(*ok), lambda x: x))


def unseen(rows: DataFrame, key: str, *pools: DataFrame) -> DataFrame:
    """One row a key, of the keys that no pool (candidates, rejected) holds."""
    out = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    for p in pools:
        out = exclude(out, key, p, key)
    return out


def by_rounded_mass(masses: DataFrame, table: DataFrame, digits: int = 4, structure: str = "structure") -> DataFrame:
    """`masses` (mass, structure, ...) with the smallest frag_id of `table` (frag_id, mass, structure) that has the same
    rounded mass and structure, or null (J15): an equi-join, no search by tolerance."""
    p = float(10**digits)
    key = lambda c: F.floor(F.col(c) * p + 0.5).cast("long")
    known = table.groupBy(key("mass").alias("_mass"), F.col(structure).alias("_structure")).agg(F.min("frag_id").alias("frag_id"))
    return masses.join(known, (key("mass") == F.col("_mass")) & (F.col(structure) == F.col("_structure")), "left").drop("_mass", "_structure")


def fragments_near(peaks: DataFrame, fragments: DataFrame, tolerance: float, frag: str = "frag") -> DataFrame:
    """(spec_id, mz, intensity, fragments, frags): peaks with the sorted fragments (spec_id, frag, mass) within tolerance (inclusive), and how many; peaks without one drop out."""
    cells = F.explode(F.array(*[F.floor(F.col("mass") / tolerance) + k for k in (-1, 0, 1)]))
    f = fragments.select(F.col("spec_id").alias("_spec"), F.col(frag).alias("_frag"), "mass").withColumn("_cell", cells)
    near = peaks.join(f, (F.col("spec_id") == F.col("_spec")) & (F.floor(F.col("mz") / tolerance) == F.col("_cell")) & (F.abs(F.col("mz") - F.col("mass")) <= tolerance))
    return near.groupBy("spec_id", "mz", "intensity").agg(F.count("*").alias("fragments"), F.array_sort(F.collect_list("_frag")).alias("frags"))


def retention_class(text: Column, column: str) -> Column:
    """(value, deviation) of "Class=value/deviation ..." in a retention index text, null where the class is absent."""
    part = lambda k: F.nullif(F.regexp_extract(text, rf"\b{column}=([-+0-9.]+)(?:/([-+0-9.]+))?", k), F.lit("")).cast("double")
    return F.struct(part(1).alias("value"), part(2).alias("deviation"))


def catalog_spectra(molecules: DataFrame, spectra: DataFrame) -> DataFrame:
    """Molecules (name, smiles, inchi) with their spectra by name (S11, J9): peaks from the JSON texts peakindex and peakintensity."""
    ints = lambda c: F.from_json(c, "array<double>")
    peaks = F.transform(F.arrays_zip(ints("peakindex").alias("m"), ints("peakintensity").alias("i")), lambda x: F.struct(x["m"].alias("mz"), x["i"].alias("intensity")))
    return molecules.join(spectra.select("name", F.col("RI").alias("retention"), peaks.alias("peaks")), "name")


def regression_metrics(rows: DataFrame) -> DataFrame:
    """One row: mean absolute error and R² of (truth, guess) (A29); R² is null where the truth does not vary."""
    t, g = F.col("truth"), F.col("guess")
    sums = rows.agg(F.avg(F.abs(t - g)).alias("mae"), F.sum((t - g) * (t - g)).alias("_off"), F.var_pop(t).alias("_var"), F.count("*").alias("_n"))
    return sums.select(F.round("mae", 6).alias("mae"), F.round(1 - F.try_divide(F.col("_off"), F.col("_var") * F.col("_n")), 6).alias("r2"))


def position(better: Column, worse: Column, candidates: Column) -> Column:
    """0.5 (1 + (better - worse) / (n - 1)); of one candidate: 0.5."""
    return 0.5 * (1 + F.coalesce(F.try_divide(better - worse, candidates - 1), F.lit(0.0)))


def ranking_position(scored: DataFrame, answer: str = "answer") -> DataFrame:
    """(query, position): 0.5 (1 + (better - worse) / (n - 1)) of the answer among n candidates (A20); one candidate: 0.5."""
    true = F.max(F.when(F.col("lib") == F.col(answer), F.col("score"))).over(Window.partitionBy("query"))
    rows = scored.withColumn("_true", true).where("_true is not null")
    n = rows.groupBy("query").agg(F.sum((F.col("score") > F.col("_true")).cast("long")).alias("b"), F.sum((F.col("score") < F.col("_true")).cast("long")).alias("w"), F.count("*").alias("n"))
    return n.select("query", F.round(position(F.col("b"), F.col("w"), F.col("n")), 6).alias("position"))


def uncancelled(matches: DataFrame, exceptions: DataFrame, key: str, atoms: str = "atoms") -> DataFrame:
    """The matches (key, atoms as an array) without those whose atoms all lie inside one exception (key, atoms) of their key."""
    e = exceptions.select(F.col(key).alias("_key"), F.col(atoms).alias("_atoms")).distinct()
    return matches.join(e, (F.col(key) == F.col("_key")) & (F.size(F.array_except(atoms, "_atoms")) == 0), "left_anti")
