"""Ordered rules on the descriptors and match counts of molecules: rules are rows, the first that fails is the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "rule int, name string, column string, comparison string, bound double, unless string"


def described(molecules: DataFrame, key: str) -> DataFrame:
    """(key, column, value): the numeric and boolean columns of `molecules` as rows."""
    columns = [c for c, kind in molecules.dtypes if c != key and (kind in ("boolean", "double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"))]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return molecules.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def match_counts(matches: DataFrame, key: str, pattern: str = "pattern") -> DataFrame:
    """(key, column, value): how often each pattern is matched, as descriptors named after it; matches that exceptions cancel
    are taken out before (relations.uncancelled)."""
    return matches.groupBy(key, F.col(pattern).alias("column")).agg(F.count("*").cast("double").alias("value"))


def failures(values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, name): every rule that a molecule fails.

    values are (key, column, value), once a column. A rule (rule, name, column, comparison, bound, unless) fails where its
    column's value stands in the comparison (<, <=, >, >=, = or <>) to the bound, unless the column `unless` is above 0. A
    value that is null, NaN or absent fails nothing; an unknown comparison is an error. A molecule's values are gathered into
    one row, which the rules, few and broadcast, meet by an equi-join on the column: one shuffle by key, and no table that
    grows with the molecules is broadcast, however small the explosion of its columns makes it look to the planner.
    """
    v, b = F.col("value"), F.col("bound")
    tests = {"<": v < b, "<=": v <= b, ">": v > b, ">=": v >= b, "=": v == b, "<>": v != b}
    bad = F.raise_error(F.concat(F.lit("no comparison "), F.col("comparison"))).cast("boolean")
    for name, test in tests.items():
        bad = F.when(F.col("comparison") == name, test).otherwise(bad)
    whole = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(key).agg(F.collect_list(F.struct("column", "value")).alias("_v"))
    high = F.transform(F.filter("_v", lambda x: x["value"] > 0), lambda x: x["column"])
    rows = whole.select(key, high.alias("_high"), F.explode("_v").alias("_x")).select(key, "_high", "_x.*")
    spared = F.coalesce(F.col(key).isNotNull() & F.array_contains("_high", F.col("unless")), F.lit(False))
    return rows.join(F.broadcast(rules.select("rule", "name", "column", "comparison", "bound", "unless")), "column").where(bad & ~spared).select(key, "rule", "name")


def first_failures(molecules: DataFrame, values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, reason) of all molecules (key): the failed rule of the lowest number, ties to the smaller name; null where none fails."""
    first = failures(values, rules, key).groupBy(key).agg(F.min(F.struct("rule", "name")).alias("_f"))
    return molecules.select(key).join(first.hint("merge"), key, "left").select(key, F.col("_f.rule").alias("rule"), F.col("_f.name").alias("reason"))


def reasons(first: DataFrame) -> DataFrame:
    """(reason, n): molecules by their first failed rule; null are those that pass."""
    return first.groupBy("reason").agg(F.count("*").alias("n"))
