"""Text-level functions of molecules: tokens of line notations, formulas, masses, isotope patterns.

Tables of atoms are parameters: nothing about elements is fixed here.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELECTRON = 0.00054857990946  # mass in daltons, a fixed value


def tokens(smiles: Column, pairs: Sequence[str]) -> Column:
    """Tokens from left to right: one of the two-letter `pairs` where it stands, else one character."""
    return F.regexp_extract_all(smiles, F.lit("(" + "|".join([*sorted(pairs), "."]) + ")"), 1)


def token_ids(found: Column, vocabulary: Mapping[str, int], length: int, padding: int = 0) -> Column:
    """Ids of tokens, padded or null where longer than `length` or unknown."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    ids = F.transform(found, lambda t: F.try_element_at(table, t))
    fits = (F.size(found) <= length) & F.forall(ids, lambda x: x.isNotNull())
    return F.when(fits, F.concat(ids, F.array_repeat(F.lit(padding), F.lit(length) - F.size(found))))


def one_hot(ids: Column, size: int) -> Column:
    """One row of 0 and 1 an id (P25)."""
    return F.transform(ids, lambda k: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == k).cast("int")))


def counts(formula: Column) -> Column:
    """Array of (element, n) of a formula such as C8H10N4O2, in its order; repeated elements stay apart."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*)"), 1)
    n = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "([A-Z][a-z]?)", 1).alias("element"), n(x).alias("n")))


def mass(atoms: Column, masses: Mapping[str, float], charge: int = 0) -> Column:
    """Sum of the atoms' masses less `charge` electrons; null with an element not in the table."""
    table = F.create_map(*[F.lit(x) for k, v in masses.items() for x in (k, float(v))])
    return F.aggregate(atoms, F.lit(0.0), lambda s, a: s + a["n"] * F.try_element_at(table, a["element"])) - charge * ELECTRON


def only_elements(atoms: Column, allowed: Sequence[str]) -> Column:
    """Whether all atoms are of these elements."""
    return F.forall(atoms, lambda a: a["element"].isin(*allowed))


def acceptable(atoms: Column, masses: Mapping[str, float], allowed: Sequence[str], most: float = 2000.0) -> Column:
    """Whether all atoms are of these elements and their mass is at most `most` (F6); false where an element has no mass."""
    return only_elements(atoms, allowed) & F.coalesce(mass(atoms, masses) <= most, F.lit(False))


def connected(smiles: Column) -> Column:
    """Whether the notation is of one part."""
    return ~F.contains(smiles, F.lit("."))


def convolve(a: np.ndarray, b: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Pattern [k, (mass, area)] of two parts together: areas multiply, masses are the area-weighted means; faint ends go."""
    area = np.convolve(a[:, 1], b[:, 1])
    weighed = np.convolve(a[:, 0] * a[:, 1], b[:, 1]) + np.convolve(a[:, 1], b[:, 0] * b[:, 1])
    out = np.stack([np.divide(weighed, area, out=np.zeros_like(area), where=area > 0), area], 1)
    strong = np.flatnonzero(area > least * area.max())
    return out[strong[0] : strong[-1] + 1]


def pattern(atoms: Mapping[str, int], table: Mapping[str, np.ndarray]) -> np.ndarray:
    """Isotope pattern of a formula by repeated squaring of its elements' patterns (a row a nominal mass, gaps of area 0)."""
    whole = np.array([[0.0, 1.0]])
    for element, n in atoms.items():
        square = table[element]
        while n:
            if n & 1:
                whole = convolve(whole, square)
            n >>= 1
            if n:
                square = convolve(square, square)
    return whole


def isotopes(rows: DataFrame, table: Mapping[str, Sequence[tuple[float, float]]], atoms: str = "atoms", charge: int = 1, least: float = 0.01) -> DataFrame:
    """The rows without `atoms`, with `peaks`: their isotope peaks of at least `least` of the highest, summing to 100 (M9).

    An element that is not in the table gives null. Work is one small convolution a row, in Arrow batches.
    """
    known = {k: np.array(v, float) for k, v in table.items()}
    keys = [c for c in rows.columns if c != atoms]

    def one(found) -> list[dict] | None:
        n: dict[str, int] = {}
        for a in found if found is not None else []:
            n[a["element"]] = n.get(a["element"], 0) + int(a["n"])
        if not n or any(e not in known for e in n):
            return None
        p = pattern(n, known)
        p = p[p[:, 1] >= least * p[:, 1].max()]
        return [{"mz": float(m) - charge * ELECTRON, "intensity": float(x)} for m, x in zip(p[:, 0], 100 * p[:, 1] / p[:, 1].sum())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(peaks=[one(x) for x in b[atoms]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", peaks array<struct<mz: double, intensity: double>>"
    return rows.select(*keys, atoms).mapInPandas(run, schema)


def filled_isotopes(rows: DataFrame) -> DataFrame:
    """(element, place, mass, area) of isotopes (element, mass, area): by rising mass, with a peak of area 0 for every whole
    unit that is left out between two neighbours (S23). A filler's mass is that of the isotope before it plus the units
    passed, so it stays in order; place counts from 0. Isotopes without a mass drop out; equal masses stay apart."""
    by = Window.partitionBy("element").orderBy("mass", "area")
    gap = F.greatest(F.floor(F.lead("mass").over(by) - F.col("mass") - 0.5), F.lit(0))
    known = rows.where("mass is not null").withColumn("_n", F.coalesce(gap, F.lit(0)).cast("int"))
    each = known.select("element", "mass", "area", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_k"))
    each = each.select("element", (F.col("mass") + F.col("_k")).alias("mass"), F.when(F.col("_k") == 0, F.col("area")).otherwise(F.lit(0.0)).alias("area"), F.col("mass").alias("_from"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("element").orderBy("mass", "_from", "area")) - 1).select("element", "place", "mass", "area")
