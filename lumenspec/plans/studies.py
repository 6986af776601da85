"""Queries of candidate studies, annotations, dense vectors and reports, with the SQL that they must agree with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenspec.functions import dense as D
from lumenspec.functions import spectra as S
from lumenspec.operators import annotation as N
from lumenspec.operators import evaluation as E
from lumenspec.operators import matching as M
from lumenspec.operators import ranks
from lumenspec.operators import studies as T
from lumenspec.plans.catalog import _asked
from lumenspec.plans.registry import registry, rounded
from lumenspec.plans.views import bit_vectors, peaks, table, vectors, with_views
from lumenspec.operators import relations as K
from lumenspec.sources import reports as R

QUERIES, ORACLES, query = registry()

_PAIRS = with_views("vecs") + """,
s AS (SELECT a.vec_id AS query, b.vec_id AS lib, b.label AS lib_key, a.vec_id + 1 AS answer, b.vec_id % 3 <> 0 AS measured,
             round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 6) AS score FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


@query(with_views("vecs") + """, m AS (SELECT *, (vec_id % 200)::DOUBLE AS mass FROM vecs),
p AS (SELECT a.vec_id AS query, b.vec_id AS lib, list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS c,
             list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] AND b.bits[i])::INT))::DOUBLE / list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] OR b.bits[i])::INT)) AS j
      FROM m a JOIN m b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND abs(a.mass - b.mass) < 5),
s AS (SELECT query, lib, round(0.3::DOUBLE * c + 0.7::DOUBLE * j, 6) AS score FROM p), t AS (SELECT query, max(score) AS t FROM s WHERE lib = query + 1 GROUP BY query)
SELECT query, 1 + sum((score > t)::INT)::BIGINT AS rank, count(*) AS candidates FROM s JOIN t USING (query) GROUP BY query""")
def candidate_study(spark, sf_dir):
    ones = F.transform(F.split("bits", ""), lambda x: x.cast("double"))
    v = vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") % 200).cast("double").alias("mass"), "vec", ones.alias("ones"))
    a = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("answer"), "mass", "vec", "ones")
    stack = lambda d, c: np.stack(d[c].to_numpy()).astype(float)
    score = lambda x, y: T.mixed_score(M.cosines(stack(x, "vec"), stack(y, "vec")), M.bit_jaccards(stack(x, "ones"), stack(y, "ones")))
    return ranks.windowed_answers(a, v.withColumnRenamed("vec_id", "lib"), score, 5.0)


@query(_PAIRS + """, t AS (SELECT query, max(score) FILTER (WHERE measured) AS top, max(score) FILTER (WHERE measured AND lib = answer) AS m, max(score) FILTER (WHERE lib = answer) AS f FROM s GROUP BY query),
n AS (SELECT query, sum((measured AND score > m)::INT)::BIGINT AS am, sum((score > f)::INT)::BIGINT AS af FROM s JOIN t USING (query) GROUP BY query)
SELECT query, CASE WHEN top > 0.8 THEN 'measured' ELSE 'all' END AS tier,
       CASE WHEN top > 0.8 THEN CASE WHEN m IS NULL THEN 99999 ELSE 1 + am END ELSE CASE WHEN f IS NULL THEN 99999 ELSE 1 + af END END::BIGINT AS rank,
       coalesce(CASE WHEN top > 0.8 THEN m ELSE f END, 0)::DOUBLE AS score FROM t JOIN n USING (query)""")
def tiered_match(spark, sf_dir):
    return ranks.tiered_answers(*_asked(spark, sf_dir), M.cosines, 0.8)


@query(_PAIRS + """, t AS (SELECT query, max(score) AS t FROM s WHERE lib = answer GROUP BY query)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, lib)::INT AS place, lib, score FROM s JOIN t USING (query) WHERE score > t QUALIFY place <= 100""")
def better_than_answer(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    found = ranks.best_rows(ranks.with_truth(a, b, M.cosines).where("truth is not null"), b, M.cosines, 100, above_truth=True)
    return found.select("query", F.col("rank").alias("place"), "lib", "score")


@query(_PAIRS + " SELECT query, lib, lib_key FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, lib) = 1")
def best_match(spark, sf_dir):
    return ranks.best_rows(*_asked(spark, sf_dir), M.cosines, 1, columns=("lib_key",)).select("query", "lib", "lib_key")


@query(_PAIRS + """, t AS (SELECT query, max(score) AS t FROM s WHERE lib = answer GROUP BY query), r AS (SELECT query, 1 + sum((score > t)::INT) AS rank, any_value(t) AS score FROM s JOIN t USING (query) GROUP BY query)
SELECT count(*) AS queries, floor(sum(rank) / count(*))::BIGINT AS rank, round(avg(score), 6) AS score FROM r""")
def average_answer_rank(spark, sf_dir):
    n = ranks.answer_counts(*_asked(spark, sf_dir), M.cosines)
    return T.average_rank(n.select("query", (F.col("better") + 1).alias("rank"), "score"))


_SETS = with_views("vecs") + """, p AS (SELECT a.vec_id AS query, b.vec_id AS lib, list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] AND b.bits[i])::INT)) AS i,
  list_sum(list_transform(a.bits, lambda x: x::INT)) AS x, list_sum(list_transform(b.bits, lambda x: x::INT)) AS y FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


@query(_SETS + " SELECT query, count(*) FILTER (WHERE 2 * i / (x + y)::DOUBLE > 0.6) AS similar FROM p GROUP BY query")
def dice_counts(spark, sf_dir):
    return ranks.counts_above(*bit_vectors(spark, sf_dir), M.bit_dices, 0.6)


@query(_SETS + " SELECT query, lib, round(1 - (x + y - 2 * i) / 64.0::DOUBLE, 6) AS score FROM p")
def simple_matching(spark, sf_dir):
    """The share of places in which every query's fingerprint agrees with every other."""
    return rounded(M.block_scores(*bit_vectors(spark, sf_dir), M.bit_matches), "score")


@query(with_views("peaks", "merged") + """, t AS (SELECT spec_id, list(mz) AS top FROM (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) <= 3) GROUP BY spec_id)
SELECT a.spec_id, round(len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top)))::DOUBLE, 6) AS score FROM t a JOIN t b ON b.spec_id = a.spec_id + 1""")
def peak_set_jaccard(spark, sf_dir):
    merged = peaks(spark, sf_dir).groupBy("spec_id", F.round("mz").cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
    top = T.top_set(merged, 3)
    both = top.join(top.select((F.col("spec_id") - 1).alias("spec_id"), F.col("top").alias("_b")), "spec_id")
    return both.select("spec_id", F.round(T.set_jaccard(F.col("top"), F.col("_b")), 6).alias("score"))


@query("""WITH m AS (SELECT o_custkey AS key, o_orderkey AS id, o_totalprice::DOUBLE AS ri FROM orders), c AS (SELECT key, avg(ri) AS mean FROM m GROUP BY key)
SELECT id, round(coalesce(exp(-abs(ri - mean) / 1000), 0), 6) AS score FROM m JOIN c USING (key)""")
def retention_score(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("ri"))
    mean = m.groupBy("key").agg(F.avg("ri").alias("mean"))
    return m.join(mean, "key").select("id", F.round(T.retention_score(F.col("ri"), F.col("mean")), 6).alias("score"))


_ENERGY = "WITH e AS (SELECT l_orderkey % 97 AS query, l_partkey % 300 AS lib, l_linenumber AS energy, round(avg(l_discount::DOUBLE), 6) AS score FROM lineitem GROUP BY ALL), s AS (SELECT query, lib, round(sum(score), 6) AS score FROM e GROUP BY ALL)"


def _by_energy(spark, sf_dir):
    """(query, lib, energy, score): the mean discount, exact to its sixth digit whatever order tasks add in: 32 hundredths can lie on a tie."""
    discount = F.col("l_discount").cast("decimal(18,12)")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("query"), (F.col("l_partkey") % 300).alias("lib"), F.col("l_linenumber").alias("energy")).agg(F.round(F.avg(discount), 6).cast("decimal(18,6)").alias("score"))


@query(_ENERGY + " SELECT query, lib, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, lib)::INT AS rank FROM s QUALIFY rank <= 10")
def ranked_over_energies(spark, sf_dir):
    return T.ranked_over_energies(_by_energy(spark, sf_dir), 10).withColumn("score", F.col("score").cast("double"))


@query("""WITH a AS (SELECT l_orderkey AS spec_id, (l_partkey % 3)::INT AS mz, l_linenumber AS frag, sum(l_quantity::DOUBLE) AS intensity, (max(l_tax) + 0.01)::DECIMAL(18, 2) AS score FROM lineitem GROUP BY ALL)
SELECT spec_id, mz, frag, intensity, row_number() OVER (PARTITION BY spec_id, mz ORDER BY score DESC, frag)::INT AS place, round(score::DOUBLE * intensity / 100 / (sum(score) OVER (PARTITION BY spec_id, mz))::DOUBLE, 9) AS score FROM a""")
def annotation_scale(spark, sf_dir):
    keys = F.col("l_orderkey").alias("spec_id"), (F.col("l_partkey") % 3).cast("int").alias("mz"), F.col("l_linenumber").alias("frag")
    a = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("double")).alias("intensity"), (F.max(F.col("l_tax").cast("decimal(18,2)")) + F.lit("0.01").cast("decimal(18,2)")).cast("decimal(18,2)").alias("score"))
    return N.scale_annotations(a).withColumn("score", F.round("score", 9))


@query("""WITH a AS (SELECT l_suppkey AS spec_id, (l_partkey % 50)::INT AS mz, l_linenumber AS frag, l_quantity::DOUBLE AS intensity FROM lineitem)
SELECT spec_id, mz, round(sum(intensity), 6) AS intensity, string_agg(frag, ',' ORDER BY frag) AS frags FROM a GROUP BY ALL""")
def peak_merge(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spec_id"), (F.col("l_partkey") % 50).cast("int").alias("mz"), F.col("l_linenumber").alias("frag"), F.col("l_quantity").cast("double").alias("intensity"))
    return rounded(N.merge_exact(a), "intensity").withColumn("frags", F.array_join("frags", ","))


@query(with_views("peaks") + """, d AS (SELECT DISTINCT spec_id % 500 AS spec_id, mz FROM peaks), g AS (SELECT *, lag(mz) OVER (PARTITION BY spec_id ORDER BY mz) AS b FROM d), k AS (SELECT spec_id, mz FROM g WHERE b IS NULL OR mz - b > 2.05)
SELECT spec_id, mz, round(100.0::DOUBLE / count(*) OVER (PARTITION BY spec_id), 6) AS intensity FROM k""")
def uniform_spectrum(spark, sf_dir):
    return rounded(N.uniform_spectrum(peaks(spark, sf_dir).withColumn("spec_id", F.col("spec_id") % 500), 2.05), "intensity")


@query(with_views("peaks") + """, f AS (SELECT spec_id, mz AS frag, mz + 0.25 AS mass FROM peaks WHERE intensity > 20 GROUP BY ALL), p AS (SELECT DISTINCT spec_id, mz FROM peaks),
w AS (SELECT spec_id, mz, frag, exp(0 - pow((mz - mass) / 9.9::DOUBLE, 2) / 2) AS weight FROM p JOIN f USING (spec_id) WHERE abs(mz - mass) <= 29.7::DOUBLE)
SELECT spec_id, mz, frag, round(weight / sum(weight) OVER (PARTITION BY spec_id, mz), 6) AS weight FROM w""")
def gaussian_weights(spark, sf_dir):
    p = peaks(spark, sf_dir)
    f = p.where("intensity > 20").select("spec_id", F.col("mz").alias("frag"), (F.col("mz") + 0.25).alias("mass")).distinct()
    return rounded(N.gaussian_weights(p.select("spec_id", "mz").distinct(), f, 30.0), "weight")


_GRAPH = "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS mol, l_partkey % 20 AS src, (l_partkey * 7 + l_linenumber) % 20 AS dst FROM lineitem), r AS (SELECT DISTINCT mol, 0::BIGINT AS node, 0 AS depth FROM e UNION SELECT r.mol, e.dst, r.depth + 1 FROM r JOIN e ON r.mol = e.mol AND r.node = e.src WHERE r.depth < 4), d AS (SELECT mol, node, min(depth) AS depth FROM r GROUP BY ALL)"


@query(_GRAPH + " SELECT e.mol, e.src, e.dst FROM e JOIN d a ON e.mol = a.mol AND e.src = a.node JOIN d b ON e.mol = b.mol AND e.dst = b.node WHERE a.depth < b.depth")
def without_detours(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("mol"), (F.col("l_partkey") % 20).alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 20).alias("dst")).distinct()
    start = e.select("mol", F.lit(0).cast("long").alias("node"))
    return N.without_detours(e, N.depths(e, start, 4)).select("mol", "src", "dst")


_CELLS = " SELECT vec_id, i - 1 AS pos, round(v[i], 6) AS value FROM v, range(1, 65) r(i)"


def _cells(df):
    return df.select("vec_id", F.posexplode("v").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(with_views("vecs") + ", v AS (SELECT vec_id, list_transform(vec, lambda x: pow(x, 0.5)) AS v FROM vecs)" + _CELLS)
def dense_power(spark, sf_dir):
    return _cells(vectors(spark, sf_dir).select("vec_id", D.power(F.col("vec"), 0.5).alias("v")))


@query(with_views("vecs") + """, m AS (SELECT vec_id, list_transform(vec, lambda x, i: CASE WHEN i - 1 > vec_id % 60 + 5 THEN 0 ELSE x END) AS v FROM vecs),
v AS (SELECT vec_id, list_transform(v, lambda x: x * 100 / list_sum(v)) AS v FROM m)""" + _CELLS)
def dense_mass_mask(spark, sf_dir):
    masked = vectors(spark, sf_dir).select("vec_id", D.mask_by_mass(F.col("vec"), F.col("vec_id") % 60).alias("v"))
    return _cells(masked.select("vec_id", D.scale_sum(F.col("v")).alias("v")))


@query(with_views("vecs") + ", v AS (SELECT vec_id, list_transform(vec, lambda x, j: CASE WHEN vec_id % 60 - (j - 1) + 2 BETWEEN 0 AND 63 THEN vec[vec_id % 60 - (j - 1) + 3] ELSE 0 END) AS v FROM vecs)" + _CELLS)
def dense_reverse(spark, sf_dir):
    return _cells(vectors(spark, sf_dir).select("vec_id", D.reverse_by_mass(F.col("vec"), F.col("vec_id") % 60, 2).alias("v")))


@query(with_views("vecs") + " SELECT vec_id, round(ln(list_sum(list_transform(vec, lambda x: exp(x)))), 6) AS log_sum FROM vecs")
def dense_log_sum(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(D.log_sum(F.col("vec")), 6).alias("log_sum"))


@query(with_views("vecs") + """, p AS (SELECT a.vec_id, a.vec AS t, b.vec AS g FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (t[i] - g[i]) * (t[i] - g[i]))) / 64, 6) AS error,
 round(list_sum(list_transform(range(1, 65), lambda i: i * (t[i] - g[i]) * (t[i] - g[i]))) / 2080, 6) AS weighted,
 round(list_sum(list_transform(range(1, 65), lambda i: -t[i] / list_sum(t) * ln(greatest(g[i] / list_sum(g), 1e-9)))), 6) AS entropy,
 round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN t[i] > 0 THEN t[i] / list_sum(t) * ln(t[i] / list_sum(t) / greatest(g[i] / list_sum(g), 1e-9)) ELSE 0 END)), 6) AS divergence FROM p""")
def dense_losses(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "vec")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("g")), "vec_id")
    return both.select("vec_id", F.round(D.squared_error(F.col("vec"), F.col("g")), 6).alias("error"), F.round(D.divergence(F.col("vec"), F.col("g")), 6).alias("divergence"), F.round(D.weighted_squared_error(F.col("vec"), F.col("g"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: k.cast("double"))), 6).alias("weighted"), F.round(D.cross_entropy(F.col("vec"), F.col("g")), 6).alias("entropy"))


@query("SELECT max(l_linenumber) AS atoms, max(l_partkey) AS number, max(l_quantity)::DOUBLE AS peak FROM lineitem")
def global_maxima(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return K.maxima(rows, atoms="l_linenumber", number="l_partkey", peak="l_quantity")


@query("WITH p AS (SELECT l_suppkey AS key, CASE WHEN l_partkey % 40 = 0 THEN 'test' ELSE 'train' END AS part FROM lineitem) SELECT key, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM p GROUP BY key HAVING count(DISTINCT part) > 1")
def shared_keys(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_partkey") % 40 == 0, "test").otherwise("train").alias("part"))
    return T.shared_keys(p, "key", "part").withColumn("parts", F.array_join("parts", ","))


@query("""WITH p AS (SELECT c_mktsegment AS part, c_custkey AS key FROM customer), s(experiment, role, part) AS (VALUES ('one', 'train', 'BUILDING'), ('one', 'test', 'MACHINERY'), ('two', 'train', 'BUILDING'), ('two', 'train', 'HOUSEHOLD'))
SELECT DISTINCT experiment, role, key FROM p JOIN s USING (part)""")
def compose_components(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("key"))
    setup = spark.createDataFrame([("one", "train", "BUILDING"), ("one", "test", "MACHINERY"), ("two", "train", "BUILDING"), ("two", "train", "HOUSEHOLD")], "experiment string, role string, part string")
    return T.compose(parts, setup)


@query(_ENERGY + """, r AS (SELECT query AS analyte, lib, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, lib) AS rank FROM s QUALIFY rank <= 12)
SELECT analyte, ((rank - 1) // 5)::BIGINT AS line, string_agg(printf('%.6f', score) || ': ' || lib || '; ', '' ORDER BY rank) AS text FROM r GROUP BY ALL""")
def candidate_report(spark, sf_dir):
    ranked = T.ranked_over_energies(_by_energy(spark, sf_dir), 12).select(F.col("query").alias("analyte"), "rank", "lib", F.col("score").cast("double").alias("score"))
    return R.candidate_lines(ranked)


@query("SELECT l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def reason_counts(spark, sf_dir):
    return K.counts_by(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT vec_id, round(score, 6) AS score FROM (" + with_views("vecs") + """, w AS (SELECT vec_id, list_transform(vec, lambda x, i: sqrt(x) * i) AS w FROM vecs)
SELECT a.vec_id, list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)) AS score FROM w a JOIN w b ON b.vec_id = a.vec_id + 1)""")
def weighted_dot(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "vec")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("g")), "vec_id")
    return both.select("vec_id", F.round(D.weighted_dot(F.col("vec"), F.col("g")), 6).alias("score"))


_EVIDENCE = """WITH e0 AS (SELECT l_suppkey AS mol, l_partkey % 20 AS src, l_partkey % 20 + 1 + l_linenumber % 3 AS dst, avg(l_discount::DOUBLE) AS theta FROM lineitem GROUP BY ALL), t AS (SELECT mol, src, dst, theta - ln(1 + sum(exp(theta)) OVER (PARTITION BY mol, src)) AS log_p FROM e0),
k AS (SELECT mol, src AS node, 1 - sum(exp(log_p)) AS stay FROM t GROUP BY ALL), p0 AS (SELECT DISTINCT mol, 0::BIGINT AS node, 1.0::DOUBLE AS p FROM t),""" + ",".join(f"""
m{i} AS (SELECT p.mol, dst AS node, p * exp(log_p) AS p FROM p{i - 1} p JOIN t ON p.mol = t.mol AND node = src UNION ALL SELECT p.mol, p.node, p * coalesce(stay, 1) FROM p{i - 1} p LEFT JOIN k ON p.mol = k.mol AND p.node = k.node),
p{i} AS (SELECT mol, node, sum(p) AS p FROM m{i} GROUP BY ALL)""" for i in (1, 2, 3)) + """,
g0 AS (SELECT mol, src, dst FROM t WHERE (mol, src) IN (SELECT (mol, node) FROM p3 WHERE p >= 0.01) AND (mol, dst) IN (SELECT (mol, node) FROM p3 WHERE p >= 0.01))""" + "".join(f""",
g{i} AS (SELECT * FROM g{i - 1} WHERE (mol, dst) IN (SELECT (mol, src) FROM g{i - 1}) OR (mol, dst) IN (SELECT (mol, node) FROM p3 WHERE p >= 0.05))""" for i in range(1, 11)) + " SELECT * FROM g10"


@query(_EVIDENCE)
def evidence_edges(spark, sf_dir):
    """Edges of the graph of forward passes between nodes of some belief, dead ends pruned. Three steps reach nine nodes on, so ten rounds of the SQL prune all."""
    src = F.col("l_partkey") % 20
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("mol"), src.alias("src"), (src + 1 + F.col("l_linenumber") % 3).alias("dst")).agg(F.avg(F.col("l_discount").cast("double")).alias("theta"))
    e = E.transition_log_probs(e).drop("theta")
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    belief = E.forward_pass(e, start, 3).withColumnRenamed("p", "belief")
    return N.evidence(e.select("mol", "src", "dst"), belief, 0.01, belief.where("belief >= 0.05").select("mol", "node"))


@query(with_views("peaks", "norm") + """, q AS (SELECT spec_id, floor(mz * 1e10::DOUBLE + 0.5::DOUBLE) / 1e10::DOUBLE AS mz, sum(intensity) AS intensity FROM norm GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, sum(intensity) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM q WINDOW w AS (PARTITION BY spec_id ORDER BY intensity DESC, mz)),
f AS (SELECT *, min(CASE WHEN (round(run, 6) > 80 AND n > 5) OR n > 30 THEN n END) OVER (PARTITION BY spec_id) AS stop FROM r),
k AS (SELECT spec_id, mz, intensity FROM f WHERE stop IS NULL OR n <= stop)
SELECT spec_id, round(mz, 6) AS mz, round(intensity * 100.0::DOUBLE / sum(intensity) OVER (PARTITION BY spec_id), 6) AS intensity FROM k""")
def postprocess_chain(spark, sf_dir):
    return rounded(S.postprocess(peaks(spark, sf_dir), percent=80 + 5e-7), "mz", "intensity").select("spec_id", "mz", "intensity")


@query("""SELECT l_orderkey AS mol, l_linenumber AS src, sum(((p_size * 7) % 11 - 5)::DOUBLE) AS theta FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def linear_theta(spark, sf_dir):
    """Parts as the set features of each line, with weights by their size."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("src"), F.col("l_partkey").alias("feature"))
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), ((F.col("p_size") * 7) % 11 - 5).cast("double").alias("weight"))
    return E.linear_theta(f, w, ("mol", "src"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: (1 / (1 + exp(-x::DOUBLE)) > 0.5)::INT), '') AS bits FROM embeddings")
def predicted_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bit", "x"))
    bits = E.predicted_bits(rows.select("vec_id", "bit", (1 / (1 + F.exp(-F.col("x").cast("double")))).alias("p")), "vec_id")
    return bits.select("vec_id", F.array_join("bits", "").alias("bits"))


@query("""WITH l AS (SELECT l_orderkey AS mol, l_linenumber AS hit, list_distinct([l_partkey % 3, l_suppkey % 3]) AS atoms FROM lineitem)
SELECT mol, hit FROM l WHERE NOT EXISTS (SELECT 1 FROM l e WHERE e.mol = l.mol AND e.hit % 3 = 0 AND list_has_all(e.atoms, l.atoms))""")
def matches_with_exceptions(spark, sf_dir):
    """Two residues of each line as a match's atoms; every third line is an exception."""
    atoms = F.array_distinct(F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 3))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("hit"), atoms.alias("atoms"))
    return K.uncancelled(rows, rows.where("hit % 3 = 0"), "mol").select("mol", "hit")
