"""Rings, bridged ring systems and connected sets of atoms, on rows of atoms and bonds.

Bonds are rows (mol, a, b), in either direction, repeated or not; a bond of an atom to itself is none.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.tables import written


def undirected(bonds: DataFrame) -> DataFrame:
    """(mol, a, b) with a < b, once each."""
    return bonds.where("a <> b").select("mol", F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()


def both_ways(bonds: DataFrame) -> DataFrame:
    one = undirected(bonds)
    return one.unionByName(one.select("mol", F.col("b").alias("a"), F.col("a").alias("b")))


def cycles(bonds: DataFrame, most: int = 8) -> DataFrame:
    """(mol, atoms): every cycle of at most `most` atoms once, from its smallest atom on towards the smaller neighbour.

    Paths grow by one join a step, over atoms larger than their first; where they meet it again they are a cycle. Each
    step is written, so a plan holds one join.
    """
    steps = written(both_ways(bonds).select("mol", F.col("a").alias("last"), F.col("b").alias("next")))
    paths = steps.where("last < next").select("mol", F.array("last", "next").alias("path"), F.col("next").alias("last"))
    found = []
    for n in range(2, most + 1):
        met = paths.join(steps, ["mol", "last"]).where((F.col("next") >= F.col("path")[0]) & ~F.array_contains(F.slice("path", 2, n), F.col("next")))
        met = written(met.where((F.col("next") > F.col("path")[0]) | ((F.size("path") > 2) & (F.col("path")[1] < F.col("last")))) if n < most else met.where((F.col("next") == F.col("path")[0]) & (F.size("path") > 2) & (F.col("path")[1] < F.col("last"))))
        found.append(met.where(F.col("next") == F.col("path")[0]).select("mol", F.col("path").alias("atoms")))
        paths = met.where(F.col("next") > F.col("path")[0]).select("mol", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"))
    return functools.reduce(DataFrame.unionByName, found)


def _small_cycles(bonds: list[tuple[int, int]], most: int) -> list[list[int]]:
    """A molecule's cycles of at most `most` atoms, as in `cycles`."""
    near: dict[int, list[int]] = {}
    for a, b in bonds:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, paths = [], [[a, b] for a in near for b in near[a] if a < b]
    while paths:
        path = paths.pop()
        for x in near[path[-1]]:
            if x == path[0] and len(path) > 2 and path[1] < path[-1]:
                out.append(path)
            elif x > path[0] and len(path) < most and x not in path:
                paths.append([*path, x])
    return out


def _independent(found: list[list[int]]) -> list[list[int]]:
    """Of a molecule's cycles those that no sum (over GF(2), bonds as bits) of shorter or earlier ones gives."""
    bits: dict[tuple[int, int], int] = {}
    reduced: dict[int, int] = {}
    out = []
    for atoms in sorted(found, key=lambda a: (len(a), a)):
        x = 0
        for a, b in zip(atoms, atoms[1:] + atoms[:1]):
            x ^= 1 << bits.setdefault((min(a, b), max(a, b)), len(bits))
        while x and x.bit_length() in reduced:
            x ^= reduced[x.bit_length()]
        if x:
            reduced[x.bit_length()] = x
            out.append(atoms)
    return out


def rings(bonds: DataFrame, most: int = 8) -> DataFrame:
    """(mol, ring, size, atoms): a smallest set of smallest rings of at most `most` atoms (M3).

    A minimum cycle basis: cycles by size, each kept unless those before it sum to it. Among cycles of one size those
    with smaller atoms come first, so the result is the same on every run. Larger rings are not found: cycles of more
    than `most` atoms are left out of the basis. A molecule without rings has no rows. A molecule's bonds are gathered in
    one row by one shuffle, molecules pass in Arrow batches, and the rings are written, since those who ask read them again.
    """
    pair = F.struct(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    whole = bonds.where("a <> b and mol is not null").groupBy("mol").agg(F.collect_set(pair).alias("p")).where(F.size("p") > 2)
    names = ["mol", "ring", "size", "atoms"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ring, atoms = [], [], []
            for i, p in enumerate(batch.column(1).to_pylist()):
                own = _independent(_small_cycles([(x["a"], x["b"]) for x in p], most))
                at += [i] * len(own)
                ring += range(len(own))
                atoms += own
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ring, pa.int32()), pa.array([len(x) for x in atoms], pa.int32()), pa.array(atoms, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return written(whole.mapInArrow(found, f"mol {bonds.schema['mol'].dataType.simpleString()}, ring int, size int, atoms array<long>"))


def ring_atoms(found: DataFrame) -> DataFrame:
    """(mol, ring, atom): a row an atom."""
    return found.select("mol", "ring", F.explode("atoms").alias("atom"))


def ring_bonds(found: DataFrame) -> DataFrame:
    """(mol, ring, a, b) with a < b: a row a bond."""
    n = F.size("atoms")
    pairs = F.transform("atoms", lambda x, i: F.struct(F.least(x, F.col("atoms")[(i + 1) % n]).alias("a"), F.greatest(x, F.col("atoms")[(i + 1) % n]).alias("b")))
    return found.select("mol", "ring", F.explode(pairs).alias("p")).select("mol", "ring", "p.*")


def ring_census(found: DataFrame) -> DataFrame:
    """(mol, sizes, shared_atoms, shared_bonds): rings by size as a map, and how many atoms and bonds lie in several rings (M3)."""
    sizes = found.groupBy("mol", "size").agg(F.count("*").alias("n")).groupBy("mol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("sizes"))
    shared = lambda rows, keys, name: rows.groupBy("mol", *keys).agg(F.count("*").alias("n")).groupBy("mol").agg(F.count_if(F.col("n") > 1).alias(name))
    return sizes.join(shared(ring_atoms(found), ["atom"], "shared_atoms"), "mol").join(shared(ring_bonds(found), ["a", "b"], "shared_bonds"), "mol")


def bridges(found: DataFrame) -> DataFrame:
    """(mol, ring, other, atoms): pairs of rings that share more than two atoms, with these (M4).

    An equi-join of ring atoms with themselves, counted by pair of rings. Each pair is looked at by itself.
    """
    rows = ring_atoms(found)
    pairs = rows.join(rows.withColumnRenamed("ring", "other"), ["mol", "atom"]).where("ring < other")
    return pairs.groupBy("mol", "ring", "other").agg(F.array_sort(F.collect_list("atom")).alias("atoms")).where(F.size("atoms") > 2)


def bridge_atoms(bridged: DataFrame) -> DataFrame:
    """(mol, atom, several): atoms of bridges, and whether they serve several pairs of rings."""
    return bridged.select("mol", F.explode("atoms").alias("atom")).groupBy("mol", "atom").agg((F.count("*") > 1).alias("several"))


def bridge_bonds(found: DataFrame) -> DataFrame:
    """(mol, a, b): bonds that two rings share which share more than one."""
    rows = ring_bonds(found)
    pairs = rows.join(rows.withColumnRenamed("ring", "other"), ["mol", "a", "b"]).where("ring < other")
    shared = pairs.groupBy("mol", "ring", "other").agg(F.collect_list(F.struct("a", "b")).alias("p")).where(F.size("p") > 1)
    return shared.select("mol", F.explode("p").alias("p")).select("mol", "p.*").distinct()


def bridge_heads(bridged: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, atom): the ends of bridges, atoms with exactly one neighbour among their bridge's atoms."""
    rows = bridged.select("mol", "ring", "other", F.explode("atoms").alias("a"))
    near = rows.join(both_ways(bonds), ["mol", "a"]).join(rows.withColumnRenamed("a", "b"), ["mol", "ring", "other", "b"])
    return near.groupBy("mol", "ring", "other", "a").agg(F.count("*").alias("n")).where("n = 1").select("mol", F.col("a").alias("atom")).distinct()


def neighbours(hydrogens: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, h, near): for hydrogens (mol, h, target) the sorted others whose target is the same or bonded to it."""
    hs = hydrogens.select("mol", F.col("h").cast("long").alias("h"), F.col("target").cast("long").alias("target")).distinct()
    to = both_ways(bonds).select("mol", "a", "b").unionByName(hs.select("mol", F.col("target").alias("a"), F.col("target").alias("b")).distinct())
    pairs = hs.join(to, (hs["mol"] == to["mol"]) & (hs["target"] == to["a"])).select(hs["mol"], "h", "b")
    pairs = pairs.join(hs.select("mol", F.col("h").alias("other"), F.col("target").alias("b")), ["mol", "b"]).where("h <> other")
    near = pairs.groupBy("mol", "h").agg(F.array_sort(F.collect_set("other")).alias("near"))
    return hs.select("mol", "h").distinct().join(near, ["mol", "h"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))


def connected_sets(near: DataFrame, most: int) -> DataFrame:
    """(mol, members): every connected set of 1 to `most` nodes of (mol, h, near), made once.

    A set grows from its smallest node by a frontier in order: taking a node gives up the frontier before it, and adds
    those neighbours of the node that no member has seen. So no set is made twice and nothing is to be deduplicated.
    """
    near = written(near)
    sets = near.select("mol", F.array("h").alias("members"), F.filter("near", lambda x: x > F.col("h")).alias("ahead"), F.array_union(F.array("h"), F.col("near")).alias("seen"))
    out = [sets.select("mol", "members")]
    for k in range(1, most):
        taken = sets.select("mol", "members", "ahead", "seen", F.posexplode("ahead").alias("i", "h")).join(near, ["mol", "h"])
        new = F.filter("near", lambda x: (x > F.col("members")[0]) & ~F.array_contains("seen", x))
        rest = F.slice("ahead", F.col("i") + 2, F.size("ahead"))
        sets = taken.select("mol", F.concat("members", F.array("h")).alias("members"), F.concat(rest, new).alias("ahead"), F.array_union("seen", "near").alias("seen"))
        sets = written(sets) if k < most - 1 else sets
        out.append(sets.select("mol", "members"))
    return functools.reduce(DataFrame.unionByName, out)


def connected_tuples(hydrogens: DataFrame, bonds: DataFrame, most: int = 3) -> DataFrame:
    """(mol, tuple): every ordered choice of 1 to `most` hydrogens whose targets lie together on the heavy atoms.

    Hydrogens are rows (mol, h, target), once each; two are near if they share their target or their targets are bonded.
    """
    sets = connected_sets(neighbours(hydrogens, bonds), most)
    orders = lambda n: F.array(*[F.array(*[F.col("members")[i] for i in p]) for p in itertools.permutations(range(n))])
    parts = [sets.where(F.size("members") == n).select("mol", F.explode(orders(n)).alias("tuple")) for n in range(1, most + 1)]
    return functools.reduce(DataFrame.unionByName, parts)
