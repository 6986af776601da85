"""Column expressions over dense vectors: powers, mass masks, reversal by mass, log sums, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)


def power(vec: Column, p: float) -> Column:
    """Every component to the power p; 1 / p undoes it."""
    return F.transform(vec, lambda x: F.pow(x, F.lit(float(p))))


def parse_peaks(text: Column, bins: int) -> Column:
    """Dense vector of lines "bin intensity"; bins beyond the vector are left out, the last line of a bin wins."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[ \t]+[\d.]+)"), 1), lambda x: F.split(x, r"[ \t]+"))
    last = F.aggregate(pairs, F.create_map().cast("map<int,double>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x[0].cast("int")), F.create_map(x[0].cast("int"), x[1].cast("double"))))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(last, i), F.lit(0.0)))


def peak_mask(vec: Column) -> Column:
    """1 where a component is above 0, else 0."""
    return F.transform(vec, lambda x: (x > 0).cast("double"))


def mask_by_mass(vec: Column, mass: Column, beyond: int = 5) -> Column:
    """Zero the bins above round(mass) + beyond."""
    return F.transform(vec, lambda x, i: F.when(i > F.round(mass) + beyond, F.lit(0.0)).otherwise(x))


def reverse_by_mass(vec: Column, mass: Column, shift: int = 0) -> Column:
    """out[j] = vec[mass - j + shift], 0 outside the vector."""
    return F.transform(vec, lambda _, j: F.coalesce(F.get(vec, (mass - j + shift).cast("int")), F.lit(0.0)))


def gated(forward: Column, backward: Column, gate: Column) -> Column:
    """gate * forward + (1 - gate) * backward, by component."""
    return F.transform(F.arrays_zip(forward.alias("f"), backward.alias("b"), gate.alias("g")), lambda x: x["g"] * x["f"] + (1 - x["g"]) * x["b"])


def scale_sum(vec: Column, to: float = 100.0) -> Column:
    """Components times to / their sum; as they are where the sum is not positive."""
    s = total(vec)
    return F.when(s > 0, F.transform(vec, lambda x: x * to / s)).otherwise(vec)


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sum(vec: Column) -> Column:
    """log of the sum of exp over components, without overflow."""
    top = F.array_max(vec)
    return top + F.log(F.aggregate(vec, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def weighted_dot(a: Column, b: Column) -> Column:
    """Cosine of sqrt(a) (i + 1) and sqrt(b) (i + 1) (A14); 0 where a vector is zero."""
    w = lambda v: F.transform(v, lambda x, i: F.sqrt(x) * (i + 1))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = w(a), w(b)
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.when(dot(x, x) * dot(y, y) == 0, F.lit(0.0)))


def squared_error(truth: Column, guess: Column) -> Column:
    """Mean squared error of components."""
    return total(F.zip_with(truth, guess, lambda t, g: (t - g) * (t - g))) / F.size(truth)


def weighted_squared_error(truth: Column, guess: Column, weights: Column) -> Column:
    """Squared errors of components, weighted and divided by the sum of the weights (A19); null where that is 0."""
    errors = F.zip_with(F.zip_with(truth, guess, lambda t, g: (t - g) * (t - g)), weights, lambda e, w: e * w)
    return F.try_divide(total(errors), total(weights))


def cross_entropy(truth: Column, guess: Column, least: float = 1e-9) -> Column:
    """Cross-entropy of the vectors as distributions; guesses are `least` at least."""
    return total(F.zip_with(scale_sum(truth, 1.0), scale_sum(guess, 1.0), lambda t, g: -t * F.log(F.greatest(g, F.lit(least)))))


def divergence(truth: Column, guess: Column, least: float = 1e-9) -> Column:
    """Kullback-Leibler divergence of the vectors as distributions; guesses are `least` at least."""
    p, q = scale_sum(truth, 1.0), scale_sum(guess, 1.0)
    return total(F.zip_with(p, q, lambda t, g: F.when(t > 0, t * F.log(t / F.greatest(g, F.lit(least)))).otherwise(0.0)))


def margin_loss(right: Column, best_wrong: Column, margin: float = 0.1) -> Column:
    """max(0, margin - right + best_wrong)."""
    return F.greatest(F.lit(0.0), margin - right + best_wrong)
