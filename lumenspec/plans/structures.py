"""Queries of readers, graphs of atoms, rules, fitted beliefs and models, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenspec.functions import molecules as Mol
from lumenspec.functions import spectra as S
from lumenspec.operators import evaluation as E
from lumenspec.operators import fitting as Fit
from lumenspec.operators import graphs as G
from lumenspec.operators import matching as M
from lumenspec.operators import models as L
from lumenspec.operators import rules as Rules
from lumenspec.operators import search as Search
from lumenspec.plans.catalog import _EDGES, _edges
from lumenspec.plans.registry import registry, rounded
from lumenspec.plans.views import peaks, table, vectors, with_views
from lumenspec.sources import msp, sdf
from lumenspec.sources import parameters as P
from lumenspec.sources import reports as Reports
from lumenspec.tables import shared_path

QUERIES, ORACLES, query = registry()


# Graphs of atoms. An order stands for a molecule, its lines for bonds between the residues of two keys.

_BONDS = "b AS (SELECT DISTINCT l_orderkey AS mol, least(l_partkey % 6, l_suppkey % 6) AS a, greatest(l_partkey % 6, l_suppkey % 6) AS b FROM lineitem WHERE l_partkey % 6 <> l_suppkey % 6)"


def _bonds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), (F.col("l_partkey") % 6).alias("a"), (F.col("l_suppkey") % 6).alias("b"))


@query(f"""WITH RECURSIVE {_BONDS}, e AS (SELECT mol, a, b FROM b UNION ALL SELECT mol, b, a FROM b),
p AS (SELECT mol, [a, b] AS path FROM e WHERE a < b UNION ALL SELECT p.mol, list_append(path, e.b) FROM p JOIN e ON p.mol = e.mol AND e.a = path[-1] AND e.b > path[1] AND NOT list_contains(path, e.b) WHERE len(path) < 8)
SELECT p.mol, array_to_string(path, ',') AS atoms FROM p JOIN e ON p.mol = e.mol AND e.a = path[-1] AND e.b = path[1] WHERE len(path) > 2 AND path[2] < path[-1]""")
def molecule_cycles(spark, sf_dir):
    return G.cycles(_bonds(spark, sf_dir)).select("mol", F.array_join("atoms", ",").alias("atoms"))


@query(f"""WITH RECURSIVE {_BONDS}, e AS (SELECT mol, a, b FROM b UNION ALL SELECT mol, b, a FROM b), r AS (SELECT DISTINCT mol, a AS atom, a AS seen FROM e UNION SELECT r.mol, r.atom, e.b FROM r JOIN e ON r.mol = e.mol AND r.seen = e.a),
c AS (SELECT mol, count(*) AS atoms, count(DISTINCT least) AS parts FROM (SELECT mol, atom, min(seen) AS least FROM r GROUP BY ALL) GROUP BY mol), n AS (SELECT mol, count(*) AS bonds FROM b GROUP BY mol)
SELECT mol, bonds - atoms + parts AS rings FROM c JOIN n USING (mol) WHERE bonds > atoms - parts""")
def ring_numbers(spark, sf_dir):
    """As many rings as bonds beyond a forest: the basis is whole where all rings are small, as here."""
    return G.rings(_bonds(spark, sf_dir)).groupBy("mol").agg(F.count("*").alias("rings"))


@query()
def ring_census(spark, sf_dir):
    """Rings by size and shared atoms and bonds; tests hold it against brute force."""
    found = G.ring_census(G.rings(_bonds(spark, sf_dir)))
    sizes = F.transform(F.map_entries("sizes"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string")))
    return found.withColumn("sizes", F.array_join(sizes, " "))


@query()
def bridged_rings(spark, sf_dir):
    """Atoms of bridges between rings, those that serve several pairs, and their heads; tests hold it against brute force."""
    bonds = _bonds(spark, sf_dir)
    found = G.bridges(G.rings(bonds))
    heads = G.bridge_heads(found, bonds).withColumn("head", F.lit(True))
    return G.bridge_atoms(found).join(heads, ["mol", "atom"], "left").withColumn("head", F.coalesce("head", F.lit(False)))


@query("""WITH h AS (SELECT l_orderkey AS mol, l_linenumber AS h, min(l_partkey % 9) AS t FROM lineitem GROUP BY ALL), b AS (SELECT DISTINCT l_orderkey AS mol, l_suppkey % 9 AS a, (l_suppkey + l_linenumber) % 9 AS b FROM lineitem),
e AS (SELECT mol, a, b FROM b UNION SELECT mol, b, a FROM b), n AS (SELECT x.mol, x.h AS p, y.h AS q FROM h x JOIN h y ON x.mol = y.mol AND x.h <> y.h WHERE x.t = y.t OR EXISTS (SELECT 1 FROM e WHERE e.mol = x.mol AND e.a = x.t AND e.b = y.t)),
t AS (SELECT x.mol, x.h AS a, y.h AS b, z.h AS c FROM h x JOIN h y ON x.mol = y.mol AND x.h <> y.h JOIN h z ON x.mol = z.mol AND z.h <> x.h AND z.h <> y.h),
k AS (SELECT t.*, (SELECT count(*) FROM n WHERE n.mol = t.mol AND ((n.p = a AND n.q = b) OR (n.p = a AND n.q = c) OR (n.p = b AND n.q = c))) AS links FROM t)
SELECT mol, h::VARCHAR AS tuple FROM h UNION ALL SELECT mol, p || ',' || q FROM n UNION ALL SELECT mol, a || ',' || b || ',' || c FROM k WHERE links > 1""")
def connected_tuples(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    h = rows.groupBy(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("h")).agg(F.min(F.col("l_partkey") % 9).alias("target"))
    b = rows.select(F.col("l_orderkey").alias("mol"), (F.col("l_suppkey") % 9).alias("a"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 9).alias("b"))
    return G.connected_tuples(h, b, 3).select("mol", F.array_join("tuple", ",").alias("tuple"))


# Rules.

#: rule, name, column, comparison, bound, unless
RULES = [
    (1, "too small", "size", "<", 3.0, None), (2, "too large", "size", ">", 48.0, "long_name"), (3, "costly", "price", ">=", 1900.0, None), (4, "odd price", "price", "<", 905.0, "even"), (5, "short name", "letters", "<=", 18.0, None),
    (6, "long name", "letters", ">", 40.0, "even"), (7, "too many a", "match_a", ">", 5.0, None), (8, "no e", "match_e", "=", 0.0, None), (9, "many o", "match_o", ">=", 4.0, "match_q"), (10, "q", "match_q", ">", 1.0, None),
    (11, "x", "match_x", ">", 0.0, "long_name"), (12, "unit", "size", "=", 20.0, "even"), (13, "not thirty", "size", "=", 30.0, "costly_unit"), (14, "pair", "even", "<>", 1.0, "match_y"), (15, "y", "match_y", ">", 1.0, None),
    (16, "w", "match_w", ">", 1.0, None), (17, "cheap", "price", "<", 1000.0, "match_l"), (18, "l", "match_l", ">", 3.0, None), (19, "u", "match_u", ">", 2.0, None), (20, "t", "match_t", ">", 3.0, None),
]
_LETTERS = "aeoqxywlut"
_RULES_SQL = ", ".join(f"({k}, '{name}', '{c}', '{op}', {bound}::DOUBLE, {'NULL' if u is None else repr(u)})" for k, name, c, op, bound, u in RULES)


@query(f"""WITH d AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price, length(p_name)::DOUBLE AS letters, (p_partkey % 2 = 0)::INT::DOUBLE AS even, (length(p_name) > 35)::INT::DOUBLE AS long_name FROM part),
v AS (SELECT id, unnest(['size', 'price', 'letters', 'even', 'long_name']) AS c, unnest([size, price, letters, even, long_name]) AS x FROM d
      UNION ALL SELECT p_partkey, 'match_' || s, n FROM (SELECT p_partkey, s, (length(p_name) - length(replace(p_name, s, '')))::DOUBLE AS n FROM part, (SELECT unnest(string_split('{_LETTERS}', '')) AS s)) WHERE n > 0),
r(rule, name, c, op, bound, u) AS (VALUES {_RULES_SQL}),
f AS (SELECT v.id, rule, name FROM v JOIN r USING (c) WHERE CASE op WHEN '<' THEN x < bound WHEN '<=' THEN x <= bound WHEN '>' THEN x > bound WHEN '>=' THEN x >= bound WHEN '=' THEN x = bound ELSE x <> bound END
      AND NOT EXISTS (SELECT 1 FROM v w WHERE w.id = v.id AND w.c = r.u AND w.x > 0))
SELECT d.id, min(rule)::INT AS rule, arg_min(name, rule) AS reason FROM d LEFT JOIN f USING (id) GROUP BY d.id""")
def first_failed_rule(spark, sf_dir):
    """Twenty rules on descriptors of parts and on counts of letters in their names."""
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    described = Rules.described(p.select("id", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), F.length("p_name").alias("letters"), (F.col("id") % 2 == 0).alias("even"), (F.length("p_name") > 35).alias("long_name")), "id")
    hits = p.select("id", F.explode(F.split("p_name", "")).alias("s")).where(F.col("s").isin(*_LETTERS)).select("id", F.concat(F.lit("match_"), "s").alias("pattern"))
    values = described.unionByName(Rules.match_counts(hits, "id"))
    return Rules.first_failures(p, values, spark.createDataFrame(RULES, Rules.RULES), "id")


# Beliefs.

_FIT = _EDGES + """, s AS (SELECT mol, src, 1 - sum(exp(log_p)) AS w FROM t GROUP BY ALL), o AS (SELECT mol, src FROM t UNION SELECT mol, dst FROM t UNION SELECT mol, 0::BIGINT FROM t),
g AS (SELECT mol, src, dst, exp(log_p) AS w FROM t UNION ALL SELECT o.mol, o.src, o.src, coalesce(w, 1) FROM o LEFT JOIN s ON o.mol = s.mol AND o.src = s.src),
x1 AS (SELECT mol, dst AS node, w AS p FROM g WHERE src = 0), n AS (SELECT DISTINCT mol, dst AS node FROM g), z1 AS (SELECT mol, node, 1.0::DOUBLE AS f FROM n), z2 AS (SELECT mol, node, 1.0::DOUBLE AS f FROM n),
f0_1 AS (SELECT * FROM z1), f0_2 AS (SELECT * FROM z2)"""
for _r in (1, 2, 3):
    _FIT += f""",
u{_r} AS (SELECT g.mol, src AS node, sum(w * f) AS p FROM g JOIN f{_r - 1}_2 f ON g.mol = f.mol AND g.dst = f.node GROUP BY ALL),
m{_r}_1 AS (SELECT x.mol, x.node, x.p * f.f * u.p AS m, f.f, 1.0::DOUBLE / (1 + x.node) AS want FROM x1 x JOIN f{_r - 1}_1 f USING (mol, node) JOIN u{_r} u USING (mol, node) WHERE x.p * f.f * u.p > 0),
f{_r}_1 AS (SELECT mol, node, f * (want / sum(want) OVER (PARTITION BY mol)) / (m / sum(m) OVER (PARTITION BY mol)) AS f FROM m{_r}_1),
x{_r}_2 AS (SELECT g.mol, dst AS node, sum(x.p * f * w) AS p FROM x1 x JOIN f{_r}_1 f USING (mol, node) JOIN g ON g.mol = x.mol AND g.src = x.node GROUP BY ALL),
m{_r}_2 AS (SELECT x.mol, x.node, x.p * f.f AS m, f.f, 1.0::DOUBLE + x.node % 3 AS want FROM x{_r}_2 x JOIN f{_r - 1}_2 f USING (mol, node) WHERE x.p * f.f > 0),
f{_r}_2 AS (SELECT mol, node, f * (want / sum(want) OVER (PARTITION BY mol)) / (m / sum(m) OVER (PARTITION BY mol)) AS f FROM m{_r}_2)"""
_FIT += """,
u4 AS (SELECT g.mol, src AS node, sum(w * f) AS p FROM g JOIN f3_2 f ON g.mol = f.mol AND g.dst = f.node GROUP BY ALL),
b AS (SELECT DISTINCT mol, 0 AS step, 0::BIGINT AS node, 1.0::DOUBLE AS m FROM t UNION ALL SELECT x.mol, 1, x.node, x.p * f.f * u.p FROM x1 x JOIN f3_1 f USING (mol, node) JOIN u4 u USING (mol, node)
      UNION ALL SELECT x.mol, 2, x.node, x.p * f.f FROM x3_2 x JOIN f3_2 f USING (mol, node))
SELECT mol, step::INT AS step, node, round(m / sum(m) OVER (PARTITION BY mol, step), 6) AS belief FROM b WHERE m > 0"""


@query(_FIT)
def fitted_beliefs(spark, sf_dir):
    """Three rounds of proportional fitting of two steps' marginals."""
    e = _edges(spark, sf_dir)
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    nodes = e.select("mol", F.col("src").alias("node")).unionByName(e.select("mol", F.col("dst").alias("node"))).unionByName(start.select("mol", "node")).distinct()
    one = nodes.select("mol", F.lit(1).alias("step"), "node", (F.lit(1.0) / (1 + F.col("node"))).alias("p"))
    two = nodes.select("mol", F.lit(2).alias("step"), "node", (1.0 + F.col("node") % 3).alias("p"))
    beliefs, _ = Fit.fitted(e, start, one.unionByName(two), 2, rounds=3, least=0.0, swing=1e9)
    return rounded(beliefs, "belief")


@query()
def fitted_status(spark, sf_dir):
    """How the fit of each graph ends; tests hold it against numpy."""
    e = _edges(spark, sf_dir)
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    seen = E.forward_pass(e, start, 1).select("mol", F.lit(1).alias("step"), "node", (F.col("p") * (1 + F.col("node") % 2)).alias("p"))
    _, status = Fit.fitted(e, start, seen, 2, rounds=4)
    return status.withColumn("odd", F.col("mol") % 2)


@query(_EDGES + """, k AS (SELECT mol, src AS node, 1 - sum(exp(log_p)) AS stay FROM t GROUP BY ALL), p0 AS (SELECT DISTINCT mol, 0::BIGINT AS node, 1.0::DOUBLE AS p FROM t),""" + ",".join(f"""
m{i} AS (SELECT p.mol, dst AS node, p * exp(log_p) AS p FROM p{i - 1} p JOIN t ON p.mol = t.mol AND node = src UNION ALL SELECT p.mol, p.node, p * coalesce(stay, 1) FROM p{i - 1} p LEFT JOIN k ON p.mol = k.mol AND p.node = k.node),
p{i} AS (SELECT mol, node, sum(p) AS p FROM m{i} GROUP BY ALL)""" for i in (1, 2, 3)) + """,
i AS (SELECT mol, 0 AS energy, node, p FROM p1 UNION ALL SELECT mol, 1, node, p FROM p3),
s AS (SELECT mol, energy, node * 2 + d + 0.5::DOUBLE AS mz, sum(p * share) AS x FROM i, (VALUES (0, 0.9::DOUBLE), (1, 0.08::DOUBLE), (2, 0.02::DOUBLE)) v(d, share) GROUP BY ALL)
SELECT mol, energy, mz, round(x * 100.0::DOUBLE / sum(x) OVER (PARTITION BY mol, energy), 6) AS intensity FROM s""")
def predicted_spectra(spark, sf_dir):
    """Spectra of two energies from the messages after one step and after three, with an isotope pattern a node whose peaks overlap."""
    e = _edges(spark, sf_dir)
    start = e.select("mol", F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("p")).distinct()
    beliefs = [E.forward_pass(e, start, k).select("mol", F.lit(k).alias("step"), "node", F.col("p").alias("belief")) for k in (1, 3)]
    nodes = e.select("mol", F.col("src").alias("node")).unionByName(e.select("mol", F.col("dst").alias("node"))).distinct()
    isotopes = F.array(*[F.struct(F.lit(d + 0.5).alias("d"), F.lit(s).alias("s")) for d, s in enumerate((0.9, 0.08, 0.02))])
    patterns = nodes.select("mol", "node", F.explode(isotopes).alias("i")).select("mol", "node", (F.col("node") * 2 + F.col("i.d")).alias("mz"), F.col("i.s").alias("share"))
    energies = spark.createDataFrame([(0, 1), (1, 3)], "energy int, step int")
    return rounded(Fit.predicted_spectra(beliefs[0].unionByName(beliefs[1]), patterns, energies), "intensity")


@query("""WITH r AS (SELECT p_brand AS element, p_size + (p_partkey % 3) / 10.0::DOUBLE AS mass, count(*)::DOUBLE AS area FROM part WHERE p_size % 4 = 0 GROUP BY ALL),
n AS (SELECT *, greatest(coalesce(floor(lead(mass) OVER (PARTITION BY element ORDER BY mass, area) - mass - 0.5), 0), 0)::INT AS gap FROM r),
x AS (SELECT element, mass AS since, mass + k AS mass, CASE WHEN k = 0 THEN area ELSE 0 END AS area FROM n, range(60) u(k) WHERE k <= gap)
SELECT element, (row_number() OVER (PARTITION BY element ORDER BY mass, since, area) - 1)::INT AS place, round(mass, 6) AS mass, area FROM x""")
def filled_isotopes(spark, sf_dir):
    mass = (F.col("p_size") + (F.col("p_partkey") % 3) / F.lit(10.0)).alias("mass")
    rows = table(spark, sf_dir, "part").where("p_size % 4 = 0").groupBy(F.col("p_brand").alias("element"), mass).agg(F.count("*").cast("double").alias("area"))
    return rounded(Mol.filled_isotopes(rows), "mass")


# Readers.

def _blocks(spark, sf_dir):
    """Blocks of parts as an SDF file: some without a right counts line, without peaks, structure or mass, or with peaks that lie too high."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = (key % 5).cast("int")
    counts = F.when(key % 11 == 0, "  x  y").otherwise(F.concat(F.lpad(n.cast("string"), 3, " "), F.lit("  0  0")))
    atoms = F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, n), lambda i: F.concat(F.lit("    0.0 1.5 -2.25 C   "), i.cast("string"))), "\n")
    prop = lambda name, value: F.concat(F.lit(f"> <{name}>\n"), value, F.lit("\n\n"))
    last = F.col("p_size") * (15 + key % 20)
    peaks_text = F.concat(F.lit("10 5\n"), last.cast("string"), F.lit(' 7 "note 1 2"'))
    text = F.concat("p_name", F.lit("\n  made\n\n"), counts, F.lit("\n"), atoms, F.when(n > 0, "\n").otherwise(""), F.lit("M  END\n"), F.when(key % 13 != 0, prop(sdf.PEAKS, peaks_text)).otherwise(""), prop(sdf.STRUCTURE, F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("C"), key.cast("string")))), F.when(key % 19 != 0, prop(sdf.MASS, (F.col("p_size") * 10).cast("string"))).otherwise(""), F.lit("$$$$"))
    path = shared_path(spark, "sdf")
    p.select(text.alias("value")).write.text(path)
    return sdf.read_sdf(spark, path)


_REASON = """CASE WHEN p_partkey % 11 = 0 THEN 'unparsable' WHEN p_partkey % 5 > 3 THEN 'too many atoms' WHEN p_partkey % 13 = 0 THEN 'no peaks' WHEN p_partkey % 17 = 0 THEN 'no structure'
 WHEN p_partkey % 19 = 0 THEN 'no mass' WHEN greatest(p_size * (15 + p_partkey % 20), 10) / (p_size * 10.0::DOUBLE) >= 3 THEN 'last peak over mass' WHEN p_size * (15 + p_partkey % 20) >= 1000 THEN 'last peak too high' ELSE 'good' END"""


@query(f"SELECT p_partkey % 11 = 0 AS broken, {_REASON} AS reason, count(*) AS n, sum(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 5 END)::BIGINT AS atoms FROM part GROUP BY ALL")
def blocks_sorted_out(spark, sf_dir):
    """Blocks read in one pass into good ones and rejected ones, with the reasons."""
    good, bad = sdf.sorted_out(_blocks(spark, sf_dir), max_atoms=3)
    both = good.withColumn("reason", F.lit("good")).unionByName(bad)
    return both.groupBy(F.col("atoms").isNull().alias("broken"), "reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("atoms"), F.lit(0))).alias("atoms")).withColumn("atoms", F.greatest("atoms", F.lit(0)).cast("long"))


@query("""SELECT 'C' || p_partkey AS id, (p_size * 10)::DOUBLE AS mw, unnest([10, p_size * (15 + p_partkey % 20)])::DOUBLE AS mz, unnest([5, 7])::DOUBLE AS intensity FROM part
WHERE p_partkey % 11 > 0 AND p_partkey % 5 < 4 AND p_partkey % 13 > 0 AND p_partkey % 17 > 0 AND p_partkey % 19 > 0 AND greatest(p_size * (15 + p_partkey % 20), 10) / (p_size * 10.0::DOUBLE) < 3 AND p_size * (15 + p_partkey % 20) < 1000""")
def blocks_as_msp(spark, sf_dir):
    """Good blocks written as MSP records and read back (K6)."""
    good, _ = sdf.sorted_out(_blocks(spark, sf_dir), max_atoms=3)
    path = shared_path(spark, "msp")
    msp.write_msp(sdf.library_of(good), path)
    return msp.read_msp(spark, path).select("id", "mw", F.explode("peaks").alias("p")).select("id", "mw", "p.*")


@query("SELECT l_orderkey AS spec_id, (l_partkey % 40)::INT AS mz, arg_max(l_quantity, l_linenumber * 1000 + l_quantity)::DOUBLE AS intensity FROM lineitem GROUP BY ALL")
def dense_records(spark, sf_dir):
    """Records read as dense vectors, the last of equal m/z counting."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 40).cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity")))).alias("p"))
    records = rows.select(F.concat(F.lit("spec\nSMILES: s"), "l_orderkey").alias("name"), F.col("l_orderkey").cast("string").alias("id"), F.lit(0).alias("energy"), F.lit(None).cast("string").alias("mw"), F.lit(None).cast("string").alias("fp"), F.transform("p", lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))).alias("peaks"))
    path = shared_path(spark, "msp")
    msp.write_msp(records, path)
    dense = msp.dense_spectra(msp.read_msp(spark, path, ordered=False), 40)
    cells = dense.select(F.expr("cast(substring(structure, 2) as long)").alias("spec_id"), F.posexplode("vec").alias("mz", "intensity"))
    return cells.where("intensity <> 0")


@query("WITH w AS (SELECT l_partkey AS place, round(sum(l_quantity)::DOUBLE, 0) AS weight FROM lineitem GROUP BY 1) SELECT 'one two' AS features, 2 AS energies, place, weight FROM w WHERE place % 5 = 0 AND weight <> 0")
def parameters_roundtrip(spark, sf_dir):
    """Weights, of which a fifth is not 0, written as a file's lines and read back."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("place")).agg(F.round(F.sum(F.col("l_quantity").cast("double")), 0).alias("weight"))
    size = int(w.agg(F.max("place")).first()[0]) + 1
    lines = P.parameter_lines(w.where("place % 5 = 0"), ["one", "two"], 2, size)
    return P.read_parameters(lines).select(F.array_join("features", " ").alias("features"), "energies", "place", "weight")


# Scores by name and their report.

@query(with_views("peaks", "merged", "bins") + """, t AS (SELECT spec_id, count(*) AS k, sum(intensity) AS i, sum(intensity * mz) AS d, sum(pow(intensity, 1.2) * pow(mz, 6)) AS s FROM bins GROUP BY 1),
c AS (SELECT a.spec_id, count(*) AS n, sum(a.intensity) AS p, sum(b.intensity) AS q, sum(sqrt(a.intensity * b.intensity) * a.mz) AS d, sum(pow(a.intensity * b.intensity, 0.6) * pow(a.mz, 6)) AS s FROM bins a JOIN bins b ON b.spec_id = a.spec_id + 1 AND b.mz = a.mz GROUP BY 1),
r AS (SELECT x.spec_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(c.d * c.d / nullif(x.d * y.d, 0), 0) AS dot, coalesce(c.s * c.s / nullif(x.s * y.s, 0), 0) AS stein, x.k AS xk, y.k AS yk, x.i AS xi, y.i AS yi FROM t x JOIN t y ON y.spec_id = x.spec_id + 1 LEFT JOIN c ON c.spec_id = x.spec_id)
SELECT spec_id, round(dot, 6) AS dot, round(stein, 6) AS stein, round(100 * n / yk::DOUBLE, 6) AS precision, round(100 * n / xk::DOUBLE, 6) AS recall, round(100 * p / xi, 6) AS weighted_recall, round(100 * q / yi, 6) AS weighted_precision,
       round(2 * n / (xk + yk)::DOUBLE, 6) AS jaccard, round((p + q) / 200, 6) AS weighted_jaccard, round(100 * dot + 200 * n / (xk + yk)::DOUBLE + 100 * p / xi + 100 * q / yi, 6) AS combined FROM r""")
def named_scores(spark, sf_dir):
    """All nine scores of neighbouring spectra by name, at a tolerance that only equal m/z meet, so each peak has one partner at most."""
    p = M.as_arrays(S.bin_integer(peaks(spark, sf_dir)), "p")
    both = p.join(p.select((F.col("spec_id") - 1).alias("spec_id"), F.col("p").alias("q")), "spec_id")
    return rounded(M.scores_by_name(both, list(M.SCORE_NAMES), 0.5, 0.0), *M.SCORE_NAMES.values())


@query("SELECT c_custkey AS key FROM customer ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey LIMIT 50")
def sampled_keys(spark, sf_dir):
    return E.sample_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key", 50)


@query("""WITH m AS (SELECT l_linenumber AS k, l_suppkey AS mol, l_partkey % 7 AS node, ln(sum(l_quantity::DOUBLE)) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
s AS (SELECT mol, node, ln(sum(exp(x))) AS x FROM m WHERE k <= 2 GROUP BY ALL), p AS (SELECT s.mol, s.node, s.x + m.x AS x FROM s JOIN m ON m.k = 3 AND m.mol = s.mol AND m.node = s.node)
SELECT mol, node, round(x - ln(sum(exp(x)) OVER (PARTITION BY mol)), 6) AS log_p FROM p""")
def log_messages(spark, sf_dir):
    """Two messages added, multiplied by a third, and normalised."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("mol"), (F.col("l_partkey") % 7).alias("node")).agg(F.log(F.sum(F.col("l_quantity").cast("double"))).alias("log_p"))
    one, two, three = (rows.where(F.col("k") == k).drop("k") for k in (1, 2, 3))
    return rounded(E.log_normalised(E.log_product_messages(E.log_sum_messages(one, two), three)), "log_p")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS mol, l_partkey % 20 AS src, l_partkey % 20 + 1 + l_linenumber % 3 AS dst FROM lineitem), n AS (SELECT mol, src AS frag FROM e UNION SELECT mol, dst FROM e)
SELECT mol, 0 AS part, 0::BIGINT AS place, count(*)::VARCHAR AS text FROM n GROUP BY mol UNION ALL SELECT mol, 1, frag, frag || ' ' || (frag * 3 + 0.5) || ' C' || frag FROM n UNION ALL SELECT DISTINCT mol, 2, 0, '' FROM n
UNION ALL SELECT mol, 3, row_number() OVER (PARTITION BY mol ORDER BY src, dst), src || ' ' || dst || ' O' FROM e""")
def graph_report(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("mol"), (F.col("l_partkey") % 20).alias("src"), (F.col("l_partkey") % 20 + 1 + F.col("l_linenumber") % 3).alias("dst")).distinct()
    nodes = e.select("mol", F.col("src").alias("frag")).unionByName(e.select("mol", F.col("dst").alias("frag"))).distinct()
    fragments = nodes.select("mol", "frag", (F.col("frag") * 3 + 0.5).alias("mass"), F.concat(F.lit("C"), F.col("frag").cast("string")).alias("structure"))
    return Reports.graph_lines(fragments, e.withColumn("loss", F.lit("O")))


@query("""WITH e AS (SELECT event_type AS kind, user_id AS id, avg(value) AS a, max(value) AS b FROM events GROUP BY ALL), k AS (SELECT kind, dense_rank() OVER (ORDER BY kind) - 1 AS energy FROM (SELECT DISTINCT kind FROM e)), s AS (SELECT e.*, energy FROM e JOIN k USING (kind)),
m AS (SELECT id, sum(a) / 3 AS a, sum(b) / 3 AS b FROM s GROUP BY id), x AS (SELECT 'Energy' || energy AS section, a, b FROM s UNION ALL SELECT 'Totals', a, b FROM m)
SELECT section, round(avg(a), 6) AS mean_a, round(stddev_pop(a) / count(a), 6) AS error_a, round(avg(b), 6) AS mean_b, round(stddev_pop(b) / count(b), 6) AS error_b FROM x GROUP BY section""")
def energy_report(spark, sf_dir):
    """Figures of the report of two scores by energy, read back from its lines."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("id")).agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    kinds = e.select("kind").distinct().withColumn("energy", F.dense_rank().over(Window.orderBy("kind")) - 1)
    report = E.stats_report(e.join(kinds, "kind").select("id", "energy", "a", "b"), ["a", "b"], 3, digits=12)
    number = lambda k: F.split(F.element_at(F.split("text", ": "), 2), " ")[k].cast("double")
    found = report.where("place > 0").groupBy("section").pivot("place", [1, 2]).agg(F.round(F.max(number(0)), 6).alias("mean"), F.round(F.max(number(1)), 6).alias("error"))
    return found.select("section", F.col("1_mean").alias("mean_a"), F.col("1_error").alias("error_a"), F.col("2_mean").alias("mean_b"), F.col("2_error").alias("error_b"))


@query(with_views("peaks", "merged", "bins") + """, n AS (SELECT spec_id, sum(intensity * mz) AS norm, list(mz ORDER BY intensity DESC, mz)[1:10] AS top FROM bins GROUP BY spec_id),
f AS (SELECT vec_id, any_value(list_transform(embedding, lambda x: x > 0)) AS bits FROM embeddings GROUP BY vec_id), w AS (SELECT n.*, bits FROM n LEFT JOIN f ON spec_id = vec_id),
d AS (SELECT x.spec_id AS analyte, y.spec_id AS lib, sum(sqrt(x.intensity * x.mz) * sqrt(y.intensity * y.mz)) AS dot FROM bins x JOIN bins y ON x.spec_id % 50 = 0 AND y.spec_id % 50 <> 0 AND y.mz = x.mz GROUP BY ALL),
c AS (SELECT a.spec_id AS analyte, b.spec_id AS lib, coalesce(CASE WHEN a.norm * b.norm = 0 THEN 0 ELSE dot * dot / (a.norm * b.norm) * (len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top)))::DOUBLE) END, 0) AS x,
      CASE WHEN a.bits IS NOT NULL AND b.bits IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] AND b.bits[i])::INT)) / nullif(list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] OR b.bits[i])::INT)), 0)::DOUBLE END AS fp
      FROM w a JOIN w b ON a.spec_id % 50 = 0 AND b.spec_id % 50 <> 0 LEFT JOIN d ON d.analyte = a.spec_id AND d.lib = b.spec_id WHERE dot IS NOT NULL OR b.bits IS NOT NULL OR b.spec_id <= 800),
s AS (SELECT analyte, lib, round(CASE WHEN fp IS NULL THEN sqrt(x) ELSE 0.7::DOUBLE * sqrt(x) + 0.3::DOUBLE * fp END, 6) AS score FROM c)
SELECT analyte, lib, score, row_number() OVER (PARTITION BY analyte ORDER BY score DESC, lib)::INT AS rank FROM s QUALIFY rank <= 100""")
def smsf_topk(spark, sf_dir):
    """The hundred best of the whole library under the whole score, without a mass window. In the SQL, pairs of score 0 count up to id 800: more than a hundred, and ties go to smaller ids."""
    bins = S.bin_integer(peaks(spark, sf_dir))
    bits = vectors(spark, sf_dir).select(F.col("vec_id").alias("spec_id"), S.set_bits(F.col("bits")).alias("set")).dropDuplicates(["spec_id"])
    return Search.search_all(bins.where("spec_id % 50 = 0"), bins.where("spec_id % 50 <> 0"), bits)


# Models.

@query("""WITH f AS (SELECT DISTINCT l_orderkey AS mol, l_linenumber AS src, p_size AS feature FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT range AS unit, (range - 1) / 4.0::DOUBLE AS bias FROM range(4)),
h AS (SELECT mol, src, unit, greatest(sum(((feature * 3 + unit * 5) % 11 - 5) / 8.0::DOUBLE) + any_value(bias), 0) AS v FROM f, u GROUP BY ALL)
SELECT mol, src, round(sum(v * (unit - 1.5::DOUBLE)) + 0.25::DOUBLE, 6) AS theta FROM h GROUP BY ALL""")
def network_theta(spark, sf_dir):
    """Sizes of parts as the set features of each line, four hidden units, one output."""
    f = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("src"), F.col("p_size").cast("long").alias("feature"))
    units = spark.range(4).withColumnRenamed("id", "unit")
    first = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(60)).cast("array<long>")).alias("input")).select("input", "unit", (((F.col("input") * 3 + F.col("unit") * 5) % 11 - 5) / 8).alias("weight"))
    second = units.select(F.col("unit").alias("input"), F.lit(0).cast("long").alias("unit"), (F.col("unit") - 1.5).alias("weight"))
    layers = [(first, units.select("unit", ((F.col("unit") - 1) / 4).alias("bias")), "relu"), (second, spark.createDataFrame([(0, 0.25)], "unit long, bias double"), "linear")]
    return rounded(E.network_theta(f, layers, ("mol", "src")), "theta")


@query()
def principal_components(spark, sf_dir):
    """Two coordinates of every vector; tests hold them against numpy."""
    v = vectors(spark, sf_dir).select("vec_id", "vec")
    mean, parts, _ = L.principal_components(v)
    xy = L.projected(F.col("vec"), mean, parts)
    return v.select("vec_id", xy.alias("xy")).select("vec_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def _labelled(spark, sf_dir):
    """Vectors with eight targets: is the label k (six of them), is the first component above the second, is the third above 0."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    targets = [F.col("label") == k for k in range(6)] + [F.col("vec")[0] > F.col("vec")[1], F.col("vec")[2] > 0]
    return v.select("vec_id", "vec", F.array(*[F.coalesce(t, F.lit(False)).cast("int") for t in targets]).alias("bits"))


def _metrics(rows, coefficients, cut):
    """Accuracy, precision, recall, F1 of every target, and whether its model is of use (F8)."""
    guesses = rows.select(F.posexplode(F.arrays_zip("bits", L.scored_bits(F.col("vec"), coefficients, cut).alias("guess"))).alias("bit", "x"))
    metrics = E.bit_metrics(guesses.select("bit", F.col("x.bits").alias("truth"), F.col("x.guess").alias("guess")))
    from lumenspec.operators.relations import usable_models

    return metrics.join(usable_models(metrics).select("bit", F.lit(True).alias("usable")), "bit", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


@query()
def logistic_models(spark, sf_dir):
    """Metrics of logistic regressions of all targets; tests hold the coefficients against numpy."""
    rows = _labelled(spark, sf_dir)
    return _metrics(rows, L.logistic(rows, rounds=25)[0], 0.0)


@query()
def least_squares_models(spark, sf_dir):
    """Metrics of partial least squares regressions of all targets; tests hold the coefficients against numpy."""
    rows = _labelled(spark, sf_dir)
    return _metrics(rows, L.least_squares_components(rows, components=3), 0.5)
