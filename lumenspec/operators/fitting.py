"""Beliefs of messages fitted to given marginals, and the spectra that they predict."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.functions.spectra import normalize, quantise
from lumenspec.operators.evaluation import _steps
from lumenspec.tables import written

CONVERGED, AVERAGED, OPEN, SWINGING = "converged", "converged after averaging", "not converged", "swinging"


def _moved(rows: DataFrame, steps: DataFrame, from_: str, to: str) -> DataFrame:
    """(mol, node, p): what `rows` (mol, node, p) hand on over the steps (mol, src, dst, _p)."""
    moves = steps.select("mol", F.col(from_).alias("node"), F.col(to).alias("_to"), "_p")
    return rows.join(moves, ["mol", "node"]).groupBy("mol", F.col("_to").alias("node")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))


def _scaled(rows: DataFrame, factors: DataFrame | None, step: int) -> DataFrame:
    """Messages times the factors (mol, step, node, factor) of a step's nodes; a node without one has 1."""
    if factors is None:
        return rows
    own = factors.where(F.col("step") == step).select("mol", "node", "factor")
    return rows.join(own, ["mol", "node"], "left").select("mol", "node", (F.col("p") * F.coalesce("factor", F.lit(1.0))).alias("p"))


def _messages(steps: DataFrame, first: DataFrame, factors: DataFrame | None, order: list[int], ends: tuple[str, str]) -> dict[int, DataFrame]:
    """By step the messages that come to its nodes, without its own factors, along `order`; each is written."""
    out = {order[0]: first}
    for before, k in zip(order, order[1:]):
        out[k] = written(_moved(_scaled(out[before], factors, before), steps, *ends))
    return out


def _marginal(down: DataFrame, up: DataFrame, factors: DataFrame | None, step: int) -> DataFrame:
    """(mol, node, belief) of a step, summing to 1."""
    both = _scaled(down, factors, step).join(up.withColumnRenamed("p", "_up"), ["mol", "node"]).select("mol", "node", (F.col("p") * F.col("_up")).alias("_b")).where("_b > 0")
    return both.select("mol", "node", (F.col("_b") / F.sum("_b").over(Window.partitionBy("mol"))).alias("belief"))


def _round(steps: DataFrame, start: DataFrame, sinks: DataFrame, targets: DataFrame, factors: DataFrame | None, depth: int, observed: list[int], forward: bool) -> tuple[DataFrame, DataFrame]:
    """One sweep over the observed steps in order: new factors, and (mol, step, off) by how much each step's marginal was off its target before it was scaled.

    The messages against the sweep do not change in it and are computed once; those along it take up each new factor.
    """
    order = list(range(depth + 1))
    along, against = (("src", "dst"), ("dst", "src")) if forward else (("dst", "src"), ("src", "dst"))
    order, ends = (order, (start, sinks)) if forward else (order[::-1], (sinks, start))
    fixed = _messages(steps, ends[1], factors, order[::-1], against)
    here, off = ends[0], []
    for k, step in enumerate(order):
        if k:
            here = written(_moved(_scaled(here, factors, order[k - 1]), steps, *along))
        if step not in observed:
            continue
        now = written(_marginal(here, fixed[step], factors, step))
        want = targets.where((F.col("step") == step) & (F.col("p") > 0)).join(now, ["mol", "node"])
        want = want.select("mol", "node", (F.col("p") / F.sum("p").over(Window.partitionBy("mol"))).alias("want"))
        met = now.join(want, ["mol", "node"], "left").join(want.select("mol").distinct().withColumn("_has", F.lit(True)), "mol").withColumn("want", F.coalesce("want", F.lit(0.0)))
        met = written(met.select("mol", F.lit(step).alias("step"), "node", "belief", "want"))
        off.append(met.groupBy("mol", "step").agg(F.sum(F.abs(F.col("want") - F.col("belief"))).alias("off")))
        ratio = met.select("mol", "step", "node", (F.col("want") / F.col("belief")).alias("ratio"))
        if factors is None:
            factors = written(ratio.withColumnRenamed("ratio", "factor"))
        else:
            joined = factors.join(ratio, ["mol", "step", "node"], "full")
            factors = written(joined.select("mol", "step", "node", (F.coalesce("factor", F.lit(1.0)) * F.coalesce("ratio", F.lit(1.0))).alias("factor")))
    return factors, functools.reduce(DataFrame.unionByName, off)


def _swept(steps: DataFrame, start: DataFrame, sinks: DataFrame, targets: DataFrame, depth: int, rounds: int, least: float, swing: float, forward: bool) -> tuple[DataFrame, DataFrame]:
    """Factors, and (mol, state, rounds), after sweeps until every molecule is within `least` of its targets, swings, or has had all rounds. Molecules that are done leave the loop."""
    observed = sorted({r[0] for r in targets.select("step").distinct().collect()})
    mols = written(targets.select("mol").distinct())
    factors = before = None
    kept, states = [], []
    for k in range(1, rounds + 1):
        own = lambda d: d.join(mols, "mol", "left_semi")
        factors, off = _round(own(steps), own(start), own(sinks), own(targets), None if factors is None else own(factors), depth, observed, forward)
        off = written(off)
        last = off.join(before.withColumnRenamed("off", "_before"), ["mol", "step"]) if before is not None else off.withColumn("_before", F.lit(None).cast("double"))
        cycling = F.coalesce(F.col("off") > swing * F.col("_before"), F.lit(False)) & (F.col("_before") > 0)
        one = last.groupBy("mol").agg(F.max("off").alias("off"), F.min(cycling.cast("int")).alias("cycling"))
        state = F.when(F.col("off") < least, CONVERGED).when(F.col("cycling") == 1, SWINGING)
        state = (F.coalesce(state, F.lit(OPEN)) if k == rounds else state).alias("state")
        one = written(one.select("mol", state, F.lit(k).alias("rounds")))
        done = one.where("state is not null")
        states.append(done)
        kept.append(factors.join(done, "mol", "left_semi"))
        mols = written(one.where("state is null").select("mol"))
        before = off
        if k < rounds and not mols.take(1):
            break
    union = lambda ds: written(functools.reduce(DataFrame.unionByName, ds))
    return union(kept), union(states)


def fitted(edges: DataFrame, start: DataFrame, targets: DataFrame, depth: int, rounds: int = 200, retries: int = 3, least: float = 1e-3, swing: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(mol, step, node, belief) and (mol, status, rounds): iterative proportional fitting of messages to marginals.

    A molecule walks `depth` steps over its edges (mol, src, dst, log_p) from `start` (mol, node, p), staying where its
    edges leave something. `targets` (mol, step, node, p) say where it should be at some steps (1 to depth); each is
    scaled to 1 over the nodes that can be reached then. A round scales every such step in turn by target / marginal. A
    molecule is done when no marginal was off by `least` (in sum) in a round. It swings when, with targets that no walk
    meets, none of them came nearer by the share 1 - swing; then it starts anew with the mean of the marginals that
    sweeps up and sweeps down come to as its targets, `retries` times at most. The status says whether it converged,
    converged after averaging, or did not; `rounds` counts those of the last run. Molecules without targets have no
    rows; a target at a node that can't be reached, or of 0 or less, does not count.
    """
    steps = written(_steps(edges, start))
    start = written(start.groupBy("mol", "node").agg(F.sum("p").alias("p")))
    sinks = written(steps.select("mol", F.col("dst").alias("node")).distinct().withColumn("p", F.lit(1.0)))
    targets = written(targets.groupBy("mol", "step", "node").agg(F.sum("p").alias("p")))
    args = (depth, rounds, least, swing)
    factors, states = _swept(steps, start, sinks, targets, *args, True)
    done, status = [], []
    for retry in range(retries + 1):
        name = CONVERGED if retry == 0 else AVERAGED
        swinging = written(states.where(F.col("state") == SWINGING).select("mol"))
        last = retry == retries or not swinging.take(1)
        over = states if last else states.join(swinging, "mol", "left_anti")
        status.append(over.select("mol", F.when(F.col("state") == CONVERGED, name).otherwise(OPEN).alias("status"), "rounds"))
        done.append(factors.join(over, "mol", "left_semi"))
        if last:
            break
        own = [d.join(swinging, "mol", "left_semi") for d in (steps, start, sinks, targets)]
        back, _ = _swept(*own, *args, False)
        observed = sorted({r[0] for r in own[3].select("step").distinct().collect()})
        up, down = (_all(own[0], own[1], own[2], f.join(swinging, "mol", "left_semi"), depth).where(F.col("step").isin(observed)) for f in (factors, back))
        mean = written(up.unionByName(down).groupBy("mol", "step", "node").agg((F.sum("belief") / 2).alias("p")))
        factors, states = _swept(own[0], own[1], own[2], mean, *args, True)
    found = written(functools.reduce(DataFrame.unionByName, done))
    some = targets.select("mol").distinct()
    whole = [d.join(some, "mol", "left_semi") for d in (steps, start, sinks)]
    return _all(*whole, found, depth), functools.reduce(DataFrame.unionByName, status)


def _all(steps: DataFrame, start: DataFrame, sinks: DataFrame, factors: DataFrame, depth: int) -> DataFrame:
    """(mol, step, node, belief): the marginals of all steps under these factors."""
    order = list(range(depth + 1))
    down = _messages(steps, start, factors, order, ("src", "dst"))
    up = _messages(steps, sinks, factors, order[::-1], ("dst", "src"))
    return functools.reduce(DataFrame.unionByName, [_marginal(down[k], up[k], factors, k).select("mol", F.lit(k).alias("step"), "node", "belief") for k in order])


def predicted_spectra(beliefs: DataFrame, patterns: DataFrame, energies: DataFrame, digits: int = 10) -> DataFrame:
    """(mol, energy, mz, intensity): at each energy every node's belief, spread over its isotope pattern, summed by mass and scaled to 100.

    beliefs are (mol, step, node, belief), patterns (mol, node, mz, share), energies (energy, step): the step that an
    energy sees. Masses meet if they agree in `digits` decimals. A node without a pattern has no peak, nor has one
    without belief.
    """
    rows = beliefs.where("belief > 0").join(energies, "step").join(patterns, ["mol", "node"])
    peaks = rows.select("mol", "energy", "mz", (F.col("belief") * F.col("share")).alias("intensity"))
    key = ("mol", "energy")
    summed = peaks.groupBy(*key, "mz").agg(F.sum("intensity").alias("intensity"))
    return quantise(summed, digits, key).select("mol", "energy", "mz", "intensity")
