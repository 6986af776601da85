"""Ranks, retrieval and classification metrics, splits, sums over graphs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.tables import written


def rank_of_answers(scored: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, answer) and (query, lib, score) -> rank = 1 + number of other rows with a higher score (J2, J3, W2, W4). Unknown answers drop out."""
    truth = scored.join(answers, (F.col("query") == F.col("_q")) & (F.col("lib") == F.col("answer"))).select(F.col("query").alias("_t"), F.col("score").alias("_score")).dropDuplicates(["_t"])
    return scored.join(truth, F.col("query") == F.col("_t")).groupBy("query").agg((F.lit(1) + F.sum((F.col("score") > F.col("_score")).cast("long"))).alias("rank"))


def key_ranks(scored: DataFrame) -> DataFrame:
    """(query, query_key, lib, lib_key, score) -> 0-based best, worst and mean place of rows with the query's key."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "lib")) - 1
    same = scored.withColumn("place", place).where("query_key = lib_key")
    return same.groupBy("query").agg(F.min("place").alias("best"), F.max("place").alias("worst"), F.round(F.avg("place"), 6).alias("mean"))


def retrieval_metrics(ranks: DataFrame, rank: str, cuts: Sequence[int] = (5, 10, 25, 50, 100)) -> DataFrame:
    """One row: queries, accuracy, mean rank, recall at the cuts, mean reciprocal rank, of 0-based ranks."""
    r = F.col(rank)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return ranks.agg(F.count("*").alias("queries"), share(r == 0).alias("accuracy"), F.round(F.avg(r), 6).alias("mean_rank"), *[share(r < k).alias(f"recall_{k}") for k in cuts], F.round(F.avg(1 / (r + 1)), 6).alias("mrr"))


def bit_metrics(rows: DataFrame) -> DataFrame:
    """(bit, truth, guess as 0/1) -> accuracy, precision, recall, f1 of each bit."""
    n = lambda c: F.sum(c.cast("double"))
    t, g = F.col("truth") == 1, F.col("guess") == 1
    out = rows.groupBy("bit").agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("bit", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def predicted_bits(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, bit, p) -> bits: the probabilities rounded to 0 or 1 (a half to 0), by ascending bit."""
    bits = F.array_sort(F.collect_list(F.struct("bit", F.bround("p").cast("int").alias("on"))))
    return rows.groupBy(key).agg(F.transform(bits, lambda b: b["on"]).alias("bits"))


def mean_iou(rows: DataFrame) -> DataFrame:
    """One row: the mean of both classes' intersection over union, from one confusion matrix of all rows.
    A class that neither truth nor guess holds does not count; null without rows."""
    n = lambda c: F.sum(c.cast("double"))
    t, g = F.col("truth") == 1, F.col("guess") == 1
    m = rows.agg(n(t & g).alias("tp"), n(~t & ~g).alias("tn"), n(t != g).alias("off"))
    iou = [F.try_divide(F.col(c), F.col(c) + F.col("off")) for c in ("tp", "tn")]
    some = sum((x.isNotNull().cast("int") for x in iou), F.lit(0))
    return m.select(F.round(F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in iou), F.lit(0.0)), some), 6).alias("mean_iou"))


def mean_and_error(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, and population deviation divided by n."""
    return rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value) / F.count(value), 6).alias("error"))


def energy_means(scores: DataFrame, columns: Sequence[str], energies: int, key: str = "id") -> DataFrame:
    """(key, columns): each molecule's sum over its energies divided by `energies`, so that a missing one counts 0."""
    return scores.groupBy(key).agg(*[(F.sum(c) / energies).alias(c) for c in columns])


def stats_report(scores: DataFrame, columns: Sequence[str], energies: int, key: str = "id", digits: int = 6) -> DataFrame:
    """(section, place, text) of scores (key, energy, columns): a line a molecule and energy, then each energy's mean and error of every score, then those of the means over energies.

    Sections are "Energy<n>" and "Totals"; place 0 are a section's molecules, in order of their key in `text`, 1 and on its scores.
    """
    number = lambda c: F.format_string(f"%.{digits}g", F.col(c))
    section = F.concat(F.lit("Energy"), F.col("energy").cast("string"))
    lines = scores.select(section.alias("section"), F.lit(0).alias("place"), F.concat_ws("\t", F.col(key).cast("string"), *[number(c) for c in columns]).alias("text"))
    stats = lambda rows: rows.groupBy("section").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("error", lambda c: F.stddev_pop(c) / F.count(c)))])
    whole = energy_means(scores, columns, energies, key).select(F.lit("Totals").alias("section"), *columns)
    both = stats(scores.select(section.alias("section"), *columns)).unionByName(stats(whole))
    told = F.array(*[F.struct(F.lit(k).alias("place"), F.concat(F.lit(f"{c} (mean, std err): "), number(f"{c}_mean"), F.lit(" "), number(f"{c}_error")).alias("text")) for k, c in enumerate(columns, 1)])
    return lines.unionByName(both.select("section", F.explode(told).alias("t")).select("section", "t.*"))


def split_by_hash(keys: DataFrame, key: str, test_share: float, seed: str = "42") -> DataFrame:
    """test / train by an md5 of seed and key: independent of row order and of other keys."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return keys.withColumn("part", F.when(h < test_share, "test").otherwise("train"))


def sample_keys(keys: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """`n` of the distinct keys, those of the least md5 with the seed: the same ones on every run, and in any order of rows."""
    return keys.select(key).distinct().orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key).limit(n)


def mini_batch(rows: DataFrame, key: str, number: int, of: int, seed: str = "42") -> DataFrame:
    """The rows of batch `number` of `of`: keys are dealt by an md5, so an epoch's batches hold every key once."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.where(F.pmod(h, F.lit(of)) == number % of)


def log_sum_messages(*messages: DataFrame) -> DataFrame:
    """(mol, node, log_p): at each node the log of the sum of the messages' exps, without overflow; a node absent from a message adds nothing."""
    rows = functools.reduce(DataFrame.unionByName, [m.select("mol", "node", "log_p") for m in messages])
    top = F.max("log_p").over(Window.partitionBy("mol", "node"))
    return rows.withColumn("_top", top).groupBy("mol", "node").agg((F.max("_top") + F.log(F.sum(F.exp(F.col("log_p") - F.col("_top"))))).alias("log_p"))


def log_product_messages(*messages: DataFrame) -> DataFrame:
    """(mol, node, log_p): the messages' product at the nodes that all of them have."""
    rows = functools.reduce(DataFrame.unionByName, [m.select("mol", "node", "log_p", F.lit(k).alias("_k")) for k, m in enumerate(messages)])
    return rows.groupBy("mol", "node").agg(F.sum("log_p").alias("log_p"), F.count_distinct("_k").alias("_n")).where(F.col("_n") == len(messages)).drop("_n")


def log_normalised(message: DataFrame) -> DataFrame:
    """The message less the log of its molecule's sum, so that its exps sum to 1."""
    own = Window.partitionBy("mol")
    rows = message.withColumn("_top", F.max("log_p").over(own))
    return rows.withColumn("log_p", F.col("log_p") - F.col("_top") - F.log(F.sum(F.exp(F.col("log_p") - F.col("_top"))).over(own))).drop("_top")


def transition_log_probs(edges: DataFrame) -> DataFrame:
    """(mol, src, dst, theta) -> log_p = theta - log(1 + sum of exp(theta)) over a source's edges, without overflow."""
    own = Window.partitionBy("mol", "src")
    top = F.greatest(F.max("theta").over(own), F.lit(0.0))
    rows = edges.withColumn("_top", top)
    whole = F.exp(-F.col("_top")) + F.sum(F.exp(F.col("theta") - F.col("_top"))).over(own)
    return rows.withColumn("log_p", F.col("theta") - F.col("_top") - F.log(whole)).drop("_top")


def linear_theta(features: DataFrame, weights: DataFrame, key: Sequence[str] = ("mol", "src", "dst")) -> DataFrame:
    """(key, feature) of set features and (feature, weight) -> theta, the sum of the weights; a feature without a weight adds 0."""
    return features.join(weights, "feature", "left").groupBy(*key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("theta"))


UNITS = 256  # of a layer of a network over features
ACTIVATIONS = {"relu": lambda x: F.greatest(x, F.lit(0.0)), "logistic": lambda x: 1 / (1 + F.exp(-x)), "tanh": F.tanh, "linear": lambda x: x}


def network_theta(features: DataFrame, layers: Sequence[tuple[DataFrame, DataFrame, str]], key: Sequence[str] = ("mol", "src", "dst")) -> DataFrame:
    """(key, theta): a small network over set features (key, feature).

    Each layer is weights (input, unit, weight), biases (unit, bias) and an activation of ACTIVATIONS; a layer's units are
    the next one's inputs, and the last has one unit. A weight that is not given is 0, so a key without known
    features has what the biases make of it. Biases name a layer's units, UNITS at most; a layer is two joins and a sum.
    """
    keys = list(key)
    names = features.select(*keys).distinct()
    values = features.select(*keys, F.col("feature").alias("input")).distinct().withColumn("value", F.lit(1.0))
    for weights, biases, name in layers:
        if name not in ACTIVATIONS:
            raise ValueError(f"no activation is called {name}")
        sums = values.join(weights, "input").groupBy(*keys, "unit").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
        units = biases.select("unit", F.col("bias").cast("double").alias("bias")).limit(UNITS + 1).collect()
        if len(units) > UNITS:
            raise ValueError(f"a layer has at most {UNITS} units")
        start = names.withColumn("_u", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(x).alias("bias")) for u, x in units]))).select(*keys, "_u.*")
        both = start.join(sums, [*keys, "unit"], "full")
        z = F.coalesce("_s", F.lit(0.0)) + F.coalesce("bias", F.lit(0.0))
        values = both.select(*keys, F.col("unit").alias("input"), ACTIVATIONS[name](z).alias("value"))
    return values.select(*keys, F.col("value").alias("theta"))


def _steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mol, src, dst, _p): the edges, and from every node of them and of `nodes` (mol, node) a step to itself with what its edges leave."""
    moves = edges.select("mol", "src", "dst", F.exp("log_p").alias("_p"))
    stay = moves.groupBy("mol", "src").agg((1 - F.sum("_p")).alias("_p"))
    ends = edges.select("mol", F.col("dst").alias("src")).unionByName(nodes.select("mol", F.col("node").alias("src"))).distinct()
    sinks = ends.join(stay, ["mol", "src"], "left_anti").withColumn("_p", F.lit(1.0))
    return moves.unionByName(stay.unionByName(sinks).select("mol", "src", F.col("src").alias("dst"), "_p"))


def forward_pass(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(mol, node, p) after `depth` steps over (mol, src, dst, log_p); what stays at a source is 1 - the sum of its edges.

    Staying is a step like the others, from a node to itself, so each step is one join and one sum.
    """
    return _pass(_steps(edges, start), start.select("mol", "node", "p"), "src", "dst", depth)[-1]


def _pass(steps: DataFrame, now: DataFrame, from_: str, to: str, depth: int) -> list[DataFrame]:
    """(mol, node, p) before the first and after each of `depth` steps from one end of them to the other."""
    steps = steps.select("mol", F.col(from_).alias("node"), F.col(to).alias("_to"), "_p")
    out = [now]
    for _ in range(depth):
        now = now.join(steps, ["mol", "node"]).groupBy("mol", F.col("_to").alias("node")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))
        out.append(now)
    return out


def beliefs(edges: DataFrame, start: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """(mol, step, node, belief): messages down from `start` (mol, node, p) times messages up from what is seen after
    `depth` steps (mol, node, p: its likelihood, 0 for other nodes), each step's beliefs summing to 1 (I8).

    Only nodes that both reach are returned. Each message is written, so a plan holds one step at a time.
    """
    steps = written(_steps(edges, start))
    down, up = written(start.select("mol", "node", "p")), written(seen.select("mol", "node", "p"))
    downs, ups = [down], [up]
    for _ in range(depth):
        downs.append(written(_pass(steps, downs[-1], "src", "dst", 1)[-1]))
        ups.append(written(_pass(steps, ups[-1], "dst", "src", 1)[-1]))
    both = [d.join(u.withColumnRenamed("p", "_up"), ["mol", "node"]).select("mol", F.lit(k).alias("step"), "node", (F.col("p") * F.col("_up")).alias("_b")) for k, (d, u) in enumerate(zip(downs, reversed(ups)))]
    rows = functools.reduce(DataFrame.unionByName, both).where("_b > 0")
    return rows.select("mol", "step", "node", (F.col("_b") / F.sum("_b").over(Window.partitionBy("mol", "step"))).alias("belief"))
