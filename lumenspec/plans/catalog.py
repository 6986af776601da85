"""Queries over the derived views of the test tables, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspec.functions import spectra as S
from lumenspec.operators import detection as D
from lumenspec.operators import evaluation as E
from lumenspec.operators import matching as M
from lumenspec.operators import relations as R
from lumenspec.operators.ranks import answer_counts, best_places, key_places
from lumenspec.operators.search import search_all
from lumenspec.plans.registry import registry, rounded
from lumenspec.plans.views import bit_vectors, peaks, spec_meta, table, vectors, with_views
from lumenspec.tables import shared_path, written

QUERIES, ORACLES, query = registry()


@query(with_views("peaks", "norm") + " SELECT spec_id, mz, round(intensity, 6) AS intensity FROM norm")
def spectrum_normalize(spark, sf_dir):
    return rounded(S.normalize(peaks(spark, sf_dir)), "intensity")


@query(with_views("peaks") + " SELECT spec_id, mz, round(intensity * 100 / max(intensity) OVER (PARTITION BY spec_id), 6) AS intensity FROM peaks")
def spectrum_scale_to_max(spark, sf_dir):
    return rounded(S.scale_to_max(peaks(spark, sf_dir)), "intensity")


@query(with_views("peaks", "merged", "bins") + " SELECT spec_id, mz, round(intensity, 6) AS intensity FROM bins")
def spectrum_bin_integer(spark, sf_dir):
    return rounded(S.bin_integer(peaks(spark, sf_dir)), "intensity")


def _quantise(d: int) -> None:
    def run(spark, sf_dir):
        return rounded(S.quantise(peaks(spark, sf_dir), d), "intensity")

    QUERIES[f"quantise_d{d}"] = run
    p = f"{10**d}.0::DOUBLE"
    ORACLES[f"quantise_d{d}"] = with_views("peaks", "norm") + f" SELECT spec_id, floor(mz * {p} + 0.5) / {p} AS mz, round(sum(intensity), 6) AS intensity FROM norm GROUP BY ALL"


for _d in (0, 2, 3):
    _quantise(_d)


@query(with_views("peaks", "merged", "bins") + """,
r AS (SELECT *, row_number() OVER w AS n, sum(intensity) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM bins WINDOW w AS (PARTITION BY spec_id ORDER BY intensity DESC, mz)),
f AS (SELECT *, min(CASE WHEN (round(run, 6) > 50 AND n > 2) OR n > 5 THEN n END) OVER (PARTITION BY spec_id) AS stop FROM r)
SELECT spec_id, mz, round(intensity, 6) AS intensity FROM f WHERE stop IS NULL OR n <= stop""")
def postprocess_cumulative(spark, sf_dir):
    return rounded(S.keep_most_intense(S.bin_integer(peaks(spark, sf_dir)), 50 + 5e-7, 2, 5), "intensity")


@query(with_views("peaks", "merged") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) AS n, max(intensity) OVER (PARTITION BY spec_id) AS m FROM merged),
f AS (SELECT *, min(CASE WHEN intensity < 0.5 * m AND n >= 2 THEN n END) OVER (PARTITION BY spec_id) AS stop FROM r)
SELECT spec_id, mz, intensity FROM f WHERE stop IS NULL OR n <= stop""")
def intensity_threshold(spark, sf_dir):
    merged = peaks(spark, sf_dir).groupBy("spec_id", F.round("mz").cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
    return S.keep_above(merged, 0.5, 2)


@query(with_views("peaks", "merged") + " SELECT spec_id, mz, intensity FROM merged QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) <= 3")
def top_peaks(spark, sf_dir):
    merged = peaks(spark, sf_dir).groupBy("spec_id", F.round("mz").cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
    return S.top_n(merged, 3)


@query(with_views("peaks", "merged") + """,
n AS (SELECT *, lag(mz) OVER w AS pm, lag(intensity) OVER w AS pi, lead(mz) OVER w AS nm, lead(intensity) OVER w AS ni
      FROM merged WHERE intensity >= 2 WINDOW w AS (PARTITION BY spec_id ORDER BY mz, intensity))
SELECT spec_id, mz, intensity FROM n
WHERE NOT coalesce(abs(mz - pm) <= greatest(20, mz * 50.0 / 1e6) AND intensity < pi, false) AND NOT coalesce(abs(mz - nm) <= greatest(20, mz * 50.0 / 1e6) AND intensity < ni, false)""")
def clean_neighbors(spark, sf_dir):
    merged = peaks(spark, sf_dir).groupBy("spec_id", F.round("mz").cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
    return S.clean(merged, 20, 50, 2.0)


@query("""
WITH b AS (SELECT l_orderkey AS spec_id, l_linenumber * 1000 + l_quantity::DOUBLE AS pos, (l_partkey % 500)::INT AS mz, l_quantity::DOUBLE AS intensity FROM lineitem),
c AS (SELECT spec_id, mz, arg_max(intensity, pos) AS v FROM b GROUP BY ALL)
SELECT spec_id, mz, round(v / (max(v) OVER (PARTITION BY spec_id) + 1e-6), 6) AS intensity FROM c""")
def dense_sparse_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spec_id"), (F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("double")).alias("pos"), (F.col("l_partkey") % 500).cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    return rounded(S.sparse(S.dense(p, 2000)), "intensity")


@query(with_views("vecs") + """,
w AS (SELECT vec_id, list_transform(vec, lambda x, i: x * i::DOUBLE) AS w FROM vecs),
n AS (SELECT vec_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) AS n FROM w)
SELECT vec_id, i - 1 AS pos, round(w[i] / n, 6) AS value FROM n, range(1, 65) r(i)""")
def l2_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode(S.unit_weighted(F.col("vec"))).alias("pos", "value"))
    return rounded(v.withColumn("pos", F.col("pos").cast("long")), "value")


_MATCH = """,
a AS (SELECT spec_id AS analyte, mz, sqrt(intensity * mz) AS a FROM bins WHERE spec_id % 50 = 0), b AS (SELECT spec_id AS lib, mz, sqrt(intensity * mz) AS b FROM bins WHERE spec_id % 50 <> 0),
na AS (SELECT analyte, sum(a * a) AS n FROM a GROUP BY 1), nb AS (SELECT lib, sum(b * b) AS n FROM b GROUP BY 1),
d AS (SELECT analyte, lib, sum(a * b) AS dot FROM a JOIN b USING (mz) GROUP BY ALL),
s AS (SELECT analyte, lib, round(dot * dot / (na.n * nb.n), 6) AS score FROM d JOIN na USING (analyte) JOIN nb USING (lib))"""


@query(with_views("peaks", "merged", "bins") + _MATCH + " SELECT analyte, lib, score, row_number() OVER (PARTITION BY analyte ORDER BY score DESC, lib)::INT AS rank FROM s QUALIFY rank <= 100")
def match_topk(spark, sf_dir):
    bins = S.bin_integer(peaks(spark, sf_dir))
    return search_all(bins.where("spec_id % 50 = 0"), bins.where("spec_id % 50 <> 0"), top_n=0, shared_only=True)


@query(with_views("meta") + " SELECT a.spec_id AS analyte, l.spec_id AS lib, round(abs(a.mass - l.mass), 6) AS delta FROM meta a JOIN meta l ON a.spec_id % 50 = 0 AND l.spec_id % 50 <> 0 AND abs(a.mass - l.mass) <= 1")
def mass_window_join(spark, sf_dir):
    m = spec_meta(spark, sf_dir)
    a, b = m.where("spec_id % 50 = 0").select(F.col("spec_id").alias("analyte"), F.col("mass").alias("x")), m.where("spec_id % 50 <> 0").select(F.col("spec_id").alias("lib"), F.col("mass").alias("y"))
    return M.band_pairs(a, b, "x", "y", 1.0).select("analyte", "lib", F.round(F.abs(F.col("x") - F.col("y")), 6).alias("delta"))


@query(with_views("peaks", "merged", "bins", "meta") + _MATCH + """, m AS (SELECT s.*, abs(x.mass - y.mass) <= 5 AS near FROM s JOIN meta x ON x.spec_id = analyte JOIN meta y ON y.spec_id = lib)
SELECT analyte, lib, score, row_number() OVER (PARTITION BY analyte ORDER BY score DESC, lib)::INT AS rank FROM m WHERE near QUALIFY rank <= 100""")
def match_topk_mass_window(spark, sf_dir):
    bins = S.bin_integer(peaks(spark, sf_dir))
    return search_all(bins.where("spec_id % 50 = 0"), bins.where("spec_id % 50 <> 0"), top_n=0, shared_only=True, masses=spec_meta(spark, sf_dir), width=5.0)


_SMSF = with_views("peaks", "merged", "bins", "meta", "vecs") + """,
n AS (SELECT spec_id, sum(intensity * mz) AS norm, list(mz ORDER BY intensity DESC, mz)[1:10] AS top FROM bins GROUP BY spec_id),
f AS (SELECT vec_id, any_value(bits) AS bits FROM vecs GROUP BY vec_id),
w AS (SELECT n.*, mass, bits FROM n JOIN meta USING (spec_id) LEFT JOIN f ON spec_id = vec_id),
c AS (SELECT a.spec_id AS analyte, b.spec_id AS lib, a.norm AS na, b.norm AS nb, len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top)))::DOUBLE AS shared,
             CASE WHEN a.bits IS NOT NULL AND b.bits IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] AND b.bits[i])::INT)) / nullif(list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] OR b.bits[i])::INT)), 0)::DOUBLE END AS fp
      FROM w a JOIN w b ON a.spec_id % 50 = 0 AND b.spec_id % 50 <> 0 AND abs(a.mass - b.mass) <= 1),
d AS (SELECT analyte, lib, sum(sqrt(x.intensity * x.mz) * sqrt(y.intensity * y.mz)) AS dot FROM c JOIN bins x ON x.spec_id = analyte JOIN bins y ON y.spec_id = lib AND y.mz = x.mz GROUP BY ALL),
a AS (SELECT analyte, lib, shared, fp, CASE WHEN na * nb = 0 THEN 0 ELSE coalesce(dot * dot / (na * nb), 0) END AS cosine FROM c LEFT JOIN d USING (analyte, lib)),"""


@query(_SMSF + " s AS (SELECT analyte, lib, round(CASE WHEN fp IS NULL THEN sqrt(cosine * shared) ELSE 0.7::DOUBLE * sqrt(cosine * shared) + 0.3::DOUBLE * fp END, 6) AS score FROM a) SELECT analyte, lib, score, row_number() OVER (PARTITION BY analyte ORDER BY score DESC, lib)::INT AS rank FROM s QUALIFY rank <= 100")
def smsf_topk_window(spark, sf_dir):
    return _smsf(spark, sf_dir, 10)


@query(_SMSF + " s AS (SELECT analyte, lib, round(CASE WHEN fp IS NULL THEN cosine ELSE 0.7::DOUBLE * cosine + 0.3::DOUBLE * fp END, 6) AS score FROM a) SELECT analyte, lib, score, row_number() OVER (PARTITION BY analyte ORDER BY score DESC, lib)::INT AS rank FROM s QUALIFY rank <= 100")
def cosine_fp_topk_window(spark, sf_dir):
    return _smsf(spark, sf_dir, 0)


def _smsf(spark, sf_dir, top_n):
    bins = S.bin_integer(peaks(spark, sf_dir))
    bits = vectors(spark, sf_dir).select(F.col("vec_id").alias("spec_id"), S.set_bits(F.col("bits")).alias("set")).dropDuplicates(["spec_id"])
    return D.search(bins.where("spec_id % 50 = 0"), bins.where("spec_id % 50 <> 0"), spec_meta(spark, sf_dir), bits, 1.0, top_n)


@query(with_views("peaks", "merged") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) AS n, sum(floor(intensity)) OVER (PARTITION BY spec_id) AS total FROM merged)
SELECT spec_id, mz, intensity FROM r WHERE n <= 2 OR intensity > 0.3::DOUBLE * total""")
def filtered_peaks(spark, sf_dir):
    merged = peaks(spark, sf_dir).groupBy("spec_id", F.round("mz").cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
    return D.filter_peaks(merged, 0.3, 2)


_BITS = with_views("vecs") + """,
p AS (SELECT a.vec_id AS query, b.vec_id AS lib, a.label AS query_key, b.label AS lib_key, list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] AND b.bits[i])::INT)) AS i,
             list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] OR b.bits[i])::INT)) AS u FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


@query(_BITS + " SELECT query, lib, round(i / nullif(u, 0)::DOUBLE, 6) AS score FROM p")
def fp_jaccard(spark, sf_dir):
    """The similarity of every query's fingerprint to every other."""
    return rounded(M.block_scores(*bit_vectors(spark, sf_dir), M.bit_jaccards), "score")


_DENSE = with_views("vecs") + """,
s AS (SELECT a.vec_id AS query, b.vec_id AS lib, a.label AS query_key, b.label AS lib_key,
             round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 6) AS score FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lib) - 1 AS place FROM s),
k AS (SELECT query, min(place) AS best, max(place) AS worst, round(avg(place), 6) AS mean FROM r WHERE query_key = lib_key GROUP BY query)"""


@query(_DENSE + " SELECT * FROM k")
def dense_key_ranks(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("query_key"), "vec")
    return key_places(a, v.select(F.col("vec_id").alias("lib"), F.col("label").alias("lib_key"), "vec"), M.cosines)


@query(_DENSE + " SELECT count(*) AS queries, round(avg((best = 0)::INT), 6) AS accuracy, round(avg(best), 6) AS mean_rank, " + ", ".join(f"round(avg((best < {k})::INT), 6) AS recall_{k}" for k in (5, 10, 25, 50, 100)) + ", round(avg(1 / (best + 1)::DOUBLE), 6) AS mrr FROM k")
def rank_metrics(spark, sf_dir):
    a, b = _asked(spark, sf_dir)
    a = a.join(b.select(F.col("lib").alias("query"), F.col("lib_key").alias("query_key")), "query")
    return E.retrieval_metrics(best_places(a, b, M.cosines), "best")


@query(_DENSE + """, t AS (SELECT query, any_value(score) AS t FROM s WHERE lib = query + 1 GROUP BY query)
SELECT query, 1 + sum((score > t)::INT)::BIGINT AS rank FROM s JOIN t USING (query) GROUP BY query""")
def answer_rank(spark, sf_dir):
    return answer_counts(*_asked(spark, sf_dir), M.cosines).select("query", (F.col("better") + 1).alias("rank"))


def _asked(spark, sf_dir):
    """The stated queries (query, answer: the next vector, vec) and all vectors (lib, lib_key, measured: two of three, vec)."""
    v = vectors(spark, sf_dir)
    a = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("answer"), "vec")
    return a, v.select(F.col("vec_id").alias("lib"), F.col("label").alias("lib_key"), (F.col("vec_id") % 3 != 0).alias("measured"), "vec")


@query(with_views("vecs") + ", b AS (SELECT i - 1 AS bit, avg(bits[i]::INT) AS share FROM vecs, range(1, 65) r(i) GROUP BY i) SELECT bit, round(share, 6) AS share FROM b WHERE share BETWEEN 0.1 AND 0.9")
def bit_balance(spark, sf_dir):
    return rounded(R.balanced_bits(vectors(spark, sf_dir)), "share")


_GUESS = with_views("vecs") + ", g AS (SELECT i - 1 AS bit, bits[i]::INT AS truth, (vec[i] > 0.1)::INT AS guess FROM vecs, range(1, 65) r(i))"


def _guesses(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.posexplode(F.arrays_zip(F.split("bits", "").alias("b"), F.col("vec").alias("v"))).alias("bit", "x"))
    return v.select(F.col("bit").cast("long").alias("bit"), F.col("x.b").cast("int").alias("truth"), (F.col("x.v") > 0.1).cast("int").alias("guess"))


@query(_GUESS + """, c AS (SELECT bit, sum(truth * guess)::DOUBLE AS tp, sum((1 - truth) * guess)::DOUBLE AS fp, sum(truth * (1 - guess))::DOUBLE AS fn, count(*) AS n FROM g GROUP BY bit)
SELECT bit, round((n - fp - fn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    return E.bit_metrics(_guesses(spark, sf_dir))


@query(_GUESS + ", c AS (SELECT sum(truth * guess)::DOUBLE AS tp, sum((1 - truth) * (1 - guess))::DOUBLE AS tn, sum((truth <> guess)::INT)::DOUBLE AS off FROM g) SELECT round((tp / (tp + off) + tn / (tn + off)) / 2, 6) AS mean_iou FROM c")
def mean_iou(spark, sf_dir):
    return E.mean_iou(_guesses(spark, sf_dir))


@query("SELECT event_type AS energy, round(avg(value), 6) AS mean, round(stddev_pop(value) / count(value), 6) AS error FROM events GROUP BY 1")
def score_stats(spark, sf_dir):
    return E.mean_and_error(table(spark, sf_dir, "events").withColumnRenamed("event_type", "energy"), "value", ["energy"])


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey AS key, CASE WHEN ('0x' || substr(md5('42:' || c_custkey::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS part FROM customer")
def train_test_split(spark, sf_dir):
    return E.split_by_hash(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key", 0.2)


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 97 = 0)")
def holdout_antijoin(spark, sf_dir):
    return R.exclude(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key", table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0"), "o_custkey")


@query(with_views("meta", "vecs") + ", f AS (SELECT vec_id, any_value(array_to_string(list_transform(bits, lambda x: x::INT), '')) AS fp FROM vecs GROUP BY vec_id) SELECT spec_id, cls, fp FROM meta LEFT JOIN f ON spec_id = vec_id")
def left_merge_fp(spark, sf_dir):
    fp = vectors(spark, sf_dir).select("vec_id", F.col("bits").alias("fp"))
    return R.merge_first(spec_meta(spark, sf_dir), fp, "spec_id", "vec_id").select("spec_id", "cls", "fp")


@query(with_views("peaks") + """, f AS (SELECT spec_id, mz + 0.25 AS mass FROM peaks WHERE intensity > 40)
SELECT spec_id, mz, intensity, count(*) AS fragments FROM peaks JOIN f USING (spec_id) WHERE abs(mz - mass) <= 3 GROUP BY ALL""")
def peak_fragment_band(spark, sf_dir):
    p = peaks(spark, sf_dir)
    f = p.where("intensity > 40").select("spec_id", F.col("mz").alias("frag"), (F.col("mz") + 0.25).alias("mass"))
    return R.fragments_near(p, f, 3.0).drop("frags")


_EDGES = "WITH e AS (SELECT l_suppkey AS mol, l_partkey % 20 AS src, l_partkey % 20 + 1 + l_linenumber % 3 AS dst, avg(l_discount::DOUBLE) AS theta FROM lineitem GROUP BY ALL), t AS (SELECT mol, src, dst, theta - ln(1 + sum(exp(theta)) OVER (PARTITION BY mol, src)) AS log_p FROM e)"


def _edges(spark, sf_dir):
    src = F.col("l_partkey") % 20
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("mol"), src.alias("src"), (src + 1 + F.col("l_linenumber") % 3).alias("dst")).agg(F.avg(F.col("l_discount").cast("double")).alias("theta"))
    return E.transition_log_probs(e).drop("theta")


@query(_EDGES + " SELECT mol, src, dst, round(log_p, 6) AS log_p FROM t")
def transition_softmax(spark, sf_dir):
    return rounded(_edges(spark, sf_dir), "log_p")


@query(_EDGES + """, k AS (SELECT mol, src AS node, 1 - sum(exp(log_p)) AS stay FROM t GROUP BY ALL),
p0 AS (SELECT DISTINCT mol, 0::BIGINT AS node, 1.0::DOUBLE AS p FROM t),""" + ",".join(f"""
m{i} AS (SELECT p.mol, dst AS node, p * exp(log_p) AS p FROM p{i - 1} p JOIN t ON p.mol = t.mol AND node = src UNION ALL SELECT p.mol, p.node, p * coalesce(stay, 1) FROM p{i - 1} p LEFT JOIN k ON p.mol = k.mol AND p.node = k.node),
p{i} AS (SELECT mol, node, sum(p) AS p FROM m{i} GROUP BY ALL)""" for i in (1, 2, 3)) + " SELECT mol, node, round(p, 6) AS p FROM p3")
def forward_pass_depth3(spark, sf_dir):
    e = _edges(spark, sf_dir)
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    return rounded(E.forward_pass(e, start, 3), "p")


@query(_EDGES + """, k AS (SELECT mol, src, 1 - sum(exp(log_p)) AS w FROM t GROUP BY ALL),
o AS (SELECT mol, src FROM t UNION SELECT mol, dst FROM t UNION SELECT mol, 0::BIGINT FROM t),
g AS (SELECT mol, src, dst, exp(log_p) AS w FROM t UNION ALL SELECT o.mol, o.src, o.src, coalesce(w, 1) FROM o LEFT JOIN k ON o.mol = k.mol AND o.src = k.src),
d0 AS (SELECT DISTINCT mol, 0::BIGINT AS node, 1.0::DOUBLE AS p FROM t), d1 AS (SELECT g.mol, dst AS node, sum(p * w) AS p FROM d0 JOIN g ON d0.mol = g.mol AND node = src GROUP BY ALL),
d2 AS (SELECT g.mol, dst AS node, sum(p * w) AS p FROM d1 JOIN g ON d1.mol = g.mol AND node = src GROUP BY ALL),
u2 AS (SELECT DISTINCT mol, dst AS node, 1.0::DOUBLE / (1 + dst) AS p FROM t), u1 AS (SELECT g.mol, src AS node, sum(p * w) AS p FROM u2 JOIN g ON u2.mol = g.mol AND node = dst GROUP BY ALL),
u0 AS (SELECT g.mol, src AS node, sum(p * w) AS p FROM u1 JOIN g ON u1.mol = g.mol AND node = dst GROUP BY ALL),
b AS (""" + " UNION ALL ".join(f"SELECT d.mol, {i} AS step, d.node, d.p * u.p AS b FROM d{i} d JOIN u{i} u ON d.mol = u.mol AND d.node = u.node" for i in (0, 1, 2)) + """)
SELECT mol, step::INT AS step, node, round(b / sum(b) OVER (PARTITION BY mol, step), 6) AS belief FROM b WHERE b > 0""")
def beliefs_depth2(spark, sf_dir):
    e = _edges(spark, sf_dir)
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    seen = e.select("mol", F.col("dst").alias("node"), (F.lit(1.0) / (1 + F.col("dst"))).alias("p")).distinct()
    return rounded(E.beliefs(e, start, seen, 2), "belief")


@query()
def peak_alignment(spark, sf_dir):
    """Full one-to-one alignment with 1.1 Da, of neighbouring spectra; not SQL: tests hold it against brute force."""
    p = S.bin_integer(peaks(spark, sf_dir))
    a, b = M.as_arrays(p, "p"), M.as_arrays(p, "q").withColumnRenamed("spec_id", "other")
    return rounded(M.score_aligned(a.join(b, F.col("spec_id") + 1 == F.col("other")), 1.1, 0), "dot", "combined")


@query(with_views("peaks") + """, s AS (SELECT l_orderkey AS spec_id, l_linenumber % 2 AS energy, (l_partkey % 500 + (l_suppkey % 10) / 10.0::DOUBLE)::DOUBLE AS mz, l_quantity::DOUBLE AS intensity FROM lineitem)
SELECT spec_id, energy::INT AS energy, count(*) OVER (PARTITION BY spec_id, energy)::INT AS num_peaks, 'spec ' || spec_id AS name, CASE WHEN spec_id % 5 > 0 THEN 'line ' || spec_id END AS source, mz, intensity FROM s""")
def msp_roundtrip(spark, sf_dir):
    """Spectra of two energies, every third with annotated peaks, written as MSP text and read back peak by peak."""
    return _msp_back(spark, sf_dir)


def _msp_back(spark, sf_dir):
    from lumenspec.sources import msp

    path = shared_path(spark, "msp")
    s = peaks(spark, sf_dir, "l_linenumber").withColumn("energy", F.col("l_linenumber") % 2)
    p = s.groupBy("spec_id", "energy").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    notes = F.transform("peaks", lambda x: F.when(F.col("spec_id") % 3 == 0, F.concat(F.lit("C2H5 30 "), x["mz"].cast("string"))))
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("spec "), F.col("spec_id"), F.when(F.col("spec_id") % 5 > 0, F.concat(F.lit("\nSource: line "), F.col("spec_id"))).otherwise(""))
    msp.write_msp(p.select(name.alias("name"), F.col("spec_id").cast("string").alias("id"), "energy", none.alias("mw"), none.alias("fp"), "peaks", notes.alias("notes")), path)
    back = msp.read_msp(spark, path).select(F.col("id").cast("long").alias("spec_id"), "energy", "num_peaks", "name", F.col("params")["SOURCE"].alias("source"), F.explode("peaks").alias("p"))
    return back.select("spec_id", "energy", "num_peaks", "name", "source", "p.*")


@query(with_views("meta", "vecs") + " SELECT spec_id, spec_id IN (SELECT vec_id FROM vecs WHERE label = 1) AS known FROM meta")
def known_flag(spark, sf_dir):
    return R.flag_known(spec_meta(spark, sf_dir).select("spec_id"), "spec_id", vectors(spark, sf_dir).where("label = 1"), "vec_id")


@query(with_views("meta") + " SELECT spec_id, mass, 'predicted' AS origin, 0 AS origin_rank FROM meta WHERE spec_id % 3 = 0 UNION ALL SELECT spec_id, NULL, 'measured', 1 FROM meta WHERE spec_id % 5 = 0")
def library_union(spark, sf_dir):
    m = spec_meta(spark, sf_dir)
    return R.union_with_origin(m.where("spec_id % 3 = 0").select("spec_id", "mass"), m.where("spec_id % 5 = 0").select("spec_id"))


@query("SELECT o_custkey AS key, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1")
def keyed_lists(spark, sf_dir):
    m = R.members_by_key(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id")), "key", "id")
    return m.withColumn("members", F.array_join("members", ","))


@query("""WITH e AS (SELECT event_type AS energy, user_id AS id, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT energy, id, n FROM e WHERE id % 2 = 0)
SELECT e.id, e.energy, e.n AS p, q.n AS q FROM e JOIN q USING (id, energy)""")
def paired_spectra(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("energy"), F.col("user_id").alias("id")).agg(F.count("*").alias("peaks"))
    return R.paired(e, e.where("id % 2 = 0"))


@query("""WITH f AS (SELECT p_partkey AS frag_id, floor(p_retailprice::DOUBLE * 10000.0::DOUBLE + 0.5)::BIGINT AS m, p_size AS structure FROM part),
k AS (SELECT m, structure, min(frag_id) AS frag_id FROM f GROUP BY ALL), q AS (SELECT p_partkey AS id, floor((p_retailprice::DOUBLE + 0.00001) * 10000.0::DOUBLE + 0.5)::BIGINT AS m, p_size AS structure FROM part)
SELECT q.id, k.frag_id FROM q LEFT JOIN k USING (m, structure)""")
def fragment_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frag_id"), F.col("p_retailprice").cast("double").alias("mass"), F.col("p_size").alias("structure"))
    asked = parts.select(F.col("frag_id").alias("id"), (F.col("mass") + 0.00001).alias("mass"), "structure")
    return R.by_rounded_mass(asked, parts).select("id", "frag_id")


@query("WITH p AS (SELECT p_partkey // 6 AS key, p_size FROM part) SELECT DISTINCT key FROM p WHERE key NOT IN (SELECT key FROM p WHERE p_size > 45) AND key NOT IN (SELECT key FROM p WHERE p_size = 7)")
def unseen_keys(spark, sf_dir):
    """Groups of six parts of which none stands in either of two pools."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 6).alias("key"), "p_size")
    return R.unseen(p, "key", p.where("p_size > 45"), p.where("p_size = 7")).select("key")


@query("SELECT p_partkey AS id, p_name LIKE '%a%' AS holds FROM part WHERE p_partkey % 7 = 0")
def property_filter(spark, sf_dir):
    p = R.every_nth(table(spark, sf_dir, "part"), "p_partkey", 7)
    return p.select(F.col("p_partkey").alias("id"), R.property_contains(F.col("p_name"), "a").alias("holds"))


@query("""WITH m AS (SELECT l_extendedprice::DOUBLE / 1000 AS truth, l_quantity::DOUBLE AS guess FROM lineitem)
SELECT round(avg(abs(truth - guess)), 6) AS mae, round(1 - sum((truth - guess) * (truth - guess)) / (var_pop(truth) * count(*)), 6) AS r2 FROM m""")
def regression_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice").cast("double") / 1000).alias("truth"), F.col("l_quantity").cast("double").alias("guess"))
    return R.regression_metrics(rows)


@query(_DENSE + """, t AS (SELECT query, max(score) AS t FROM s WHERE lib = query + 1 GROUP BY query)
SELECT query, round(0.5::DOUBLE * (1 + (sum((score > t)::INT) - sum((score < t)::INT)) / (count(*) - 1)::DOUBLE), 6) AS position FROM s JOIN t USING (query) GROUP BY query""")
def ranking_position(spark, sf_dir):
    n = answer_counts(*_asked(spark, sf_dir), M.cosines)
    return n.select("query", F.round(R.position(F.col("better"), F.col("worse"), F.col("candidates")), 6).alias("position"))


@query("""WITH n AS (SELECT l_suppkey AS mol, l_linenumber AS frag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT mol, frag || ' ' || n || ' C' || n AS line FROM n""")
def fragment_list(spark, sf_dir):
    from lumenspec.sources import reports as P

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("mol"), F.col("l_linenumber").alias("frag")).agg(F.count("*").alias("n"))
    return n.select("mol", P.fragment_line(F.col("frag"), F.col("n"), F.concat(F.lit("C"), F.col("n").cast("string"))).alias("line"))
