"""Zero spectra and zero vectors in every score, text formats, and passes over graphs against plain recomputation."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenspec.functions import dense as D
from lumenspec.functions import spectra as S
from lumenspec.operators import annotation as N
from lumenspec.operators import detection as X
from lumenspec.operators import evaluation as E
from lumenspec.operators import matching as M
from lumenspec.operators import relations as R
from lumenspec.sources import libraries as L
from lumenspec.sources import reports as P


def test_zero_spectra(spark):
    p = spark.createDataFrame([(1, 0, 5.0), (2, 0, 0.0), (3, 50, 2.0), (4, 50, 3.0), (5, 50, 0.0)], "spec_id long, mz int, intensity double")
    got = {(r["analyte"], r["lib"]): r["score"] for r in M.match_bins(p.where("spec_id in (1, 3)"), p.where("spec_id not in (1, 3)")).collect()}
    assert got == {(1, 2): 0.0, (3, 4): 1.0, (3, 5): 0.0}
    masses = spark.createDataFrame([(i, 10.0) for i in range(1, 6)], "spec_id long, mass double")
    bits = spark.createDataFrame([(3, [1, 2]), (4, [2, 3])], "spec_id long, set array<int>")
    found = {(r["analyte"], r["lib"]): r["score"] for r in X.search(p.where("spec_id in (1, 3)"), p.where("spec_id not in (1, 3)"), masses, bits).collect()}
    assert found == {(1, 2): 0.0, (1, 4): 0.0, (1, 5): 0.0, (3, 2): 0.0, (3, 4): 0.8, (3, 5): 0.0}


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, vec array<double>")
    unit = {r["id"]: list(r["u"]) for r in v.select("id", S.unit_weighted(F.col("vec"), 0.0).alias("u")).collect()}
    assert unit[1] == [0.0, 0.0] and unit[2] == pytest.approx([0.6, 0.8])
    assert [r[0] for r in v.orderBy("id").select(D.weighted_dot(F.col("vec"), F.array(F.lit(1.0), F.lit(0.0)))).collect()] == pytest.approx([0.0, math.sqrt(3) / math.sqrt(3 + 16)])
    a, b = v.withColumnRenamed("id", "query"), v.withColumnRenamed("id", "lib").unionByName(v.select((F.col("id") + 5).alias("lib"), "vec"))
    got = {(r["query"], r["lib"]): r["score"] for r in M.block_scores(a, b, M.cosines).collect()}
    assert got == pytest.approx({(1, 2): 0.0, (1, 6): 0.0, (1, 7): 0.0, (2, 1): 0.0, (2, 6): 0.0, (2, 7): 1.0})
    bits = {(r["query"], r["lib"]): r["score"] for r in M.block_scores(a, b, M.bit_jaccards).collect()}
    assert bits[1, 6] is None and M.block_scores(a.limit(0), b, M.cosines).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 0)], "truth int, guess int")
    assert E.mean_iou(one).first()[0] == pytest.approx(0.25) and E.mean_iou(one.where("truth = guess")).first()[0] == 1.0
    assert E.mean_iou(one.limit(0)).first()[0] is None
    pairs = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert M.band_join(pairs, pairs.withColumnRenamed("x", "y"), "x", "y", 0).count() == 2


def test_block_scores_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_BLOCK", 7)
    monkeypatch.setattr(M, "LIBRARY_BLOCK", 11)
    x = np.random.default_rng(1).random((40, 6))
    v = spark.createDataFrame([(i, r.tolist(), f"k{i}") for i, r in enumerate(x)], "lib long, vec array<double>, key string")
    got = M.block_scores(v.where("lib % 3 = 0").select(F.col("lib").alias("query"), "vec"), v, M.cosines).collect()
    assert len(got) == 14 * 39 and all(r["key"] == f"k{r['lib']}" for r in got)
    for r in got:
        a, b = x[r["query"]], x[r["lib"]]
        assert r["score"] == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)))


def edges(r, n=60):
    return sorted({(int(m), int(a), int(b)) for m, a, b in zip(r.integers(0, 3, n), r.integers(0, 8, n), r.integers(0, 8, n)) if a != b})


def test_forward_pass_and_depths(spark):
    e = edges(np.random.default_rng(0))
    theta = {x: 0.1 * (x[1] - x[2]) for x in e} | {e[0]: 900.0}
    df = E.transition_log_probs(spark.createDataFrame([(*x, t) for x, t in theta.items()], "mol long, src long, dst long, theta double"))
    log_p = {(r["mol"], r["src"], r["dst"]): r["log_p"] for r in df.collect()}
    assert all(math.isfinite(x) for x in log_p.values())
    start = spark.createDataFrame([(m, 0, 1.0) for m in range(4)], "mol long, node long, p double")
    now = {(m, 0): 1.0 for m in range(4)}
    for _ in range(4):
        new = {}
        for (m, v), p in now.items():
            out = {x: math.exp(q) for x, q in log_p.items() if x[:2] == (m, v)}
            for x, q in out.items():
                new[m, x[2]] = new.get((m, x[2]), 0) + p * q
            new[m, v] = new.get((m, v), 0) + p * (1 - sum(out.values()))
        now = new
    got = {(r["mol"], r["node"]): r["p"] for r in E.forward_pass(df.drop("theta"), start, 4).collect()}
    assert got == pytest.approx({k: now.get(k, 0) for k in got}, abs=1e-9) and set(now) <= set(got)
    reached = {(m, 0): 0 for m in range(4)}
    for k in range(1, 4):
        for (m, v), d in list(reached.items()):
            for x in e:
                if d == k - 1 and x[:2] == (m, v):
                    reached.setdefault((m, x[2]), k)
    assert {(r["mol"], r["node"]): r["depth"] for r in N.depths(df.select("mol", "src", "dst"), start, 3).collect()} == reached


def test_evidence_to_its_fixed_point(spark):
    chain = [(1, i, i + 1) for i in range(9)] + [(1, 2, 20), (1, 20, 21), (1, 21, 22), (1, 22, 23), (2, 0, 1)]
    df = spark.createDataFrame(chain, "mol long, src long, dst long")
    belief = spark.createDataFrame([(m, v, 0.0 if v == 8 else 0.5) for m in (1, 2) for v in range(24)], "mol long, node long, belief double")
    got = {tuple(r) for r in N.evidence(df, belief, 0.1, spark.createDataFrame([(1, 5)], "mol long, node long")).collect()}
    assert got == {(1, i, i + 1) for i in range(5)}


def test_text_formats(spark, tmp_path):
    numbers = [0.0, 40.0, 54.07127368, 1e-7, 123456789012.0, 100.25, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(P.significant(F.col("x"))).collect()]
    assert got == [f"{x:.10g}" for x in numbers]
    (tmp_path / "a.msp").write_bytes(b"Name: one\r\nID: a\r\nNum Peaks: 2\r\n10 5\r\n20.5 e-\r\n30 1e1\r\n\r\nName: two\r\nID: b\r\nnum peaks: 1\r\n7 1\r\n \r\nName: three\r\nNum peaks: 0\r\n")
    lib = L.read_library(spark, f"file://{tmp_path}/a.msp")
    assert {(r["id"], r["name"], tuple(tuple(p) for p in r["peaks"])) for r in lib.collect()} == {("a", "one", ((10.0, 5.0), (30.0, 10.0))), ("b", "two", ((7.0, 1.0),)), ("three", "three", ())}
    assert L.spectra_of(lib, "b").count() == 1
    with pytest.raises(KeyError):
        L.spectra_of(lib, "none")
    with pytest.raises(ValueError):
        L.read_library(spark, "x.MSP")
    assert P.peak_pair_lines is not None and re.match(r"^3 1\.5 C$", spark.range(1).select(P.fragment_line(F.lit(3), F.lit(1.5), F.lit("C"))).first()[0])


def test_relations(spark):
    rows = spark.createDataFrame([("CC", 1.0), ("CO", None), (None, float("nan")), ("CN", 2.0), ("CN", 3.0)], "id string, x double")
    assert R.without_id(rows).count() == 4 and R.without_nan(rows, "x").count() == 3
    assert [r["id"] for r in R.unseen(rows, "id", rows.where("id = 'CO'"), rows.where("id = 'CC'")).collect()] == ["CN"]
    lists = R.members_by_key(rows.where("x is not null"), "id", "x")
    assert R.flattened(lists, "id", "x").count() == 4
    mol, spec = spark.createDataFrame([("m", "CC", "I")], "name string, smiles string, inchi string"), spark.createDataFrame([("m", "SemiStdNP=760/12/5 StdPolar=1100", "[10, 20]", "[1, 2.5]")], "name string, RI string, peakindex string, peakintensity string")
    one = R.catalog_spectra(mol, spec).select("peaks", R.retention_class(F.col("retention"), "SemiStdNP").alias("a"), R.retention_class(F.col("retention"), "StdNP").alias("b")).first()
    assert [tuple(p) for p in one["peaks"]] == [(10.0, 1.0), (20.0, 2.5)] and tuple(one["a"]) == (760.0, 12.0) and tuple(one["b"]) == (None, None)


NESTED = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.mark.parametrize("name", ["match_topk", "match_topk_mass_window", "smsf_topk_window", "fp_jaccard", "dice_counts", "simple_matching", "dense_key_ranks", "candidate_study", "forward_pass_depth3", "tiered_match"])
def test_no_nested_loops(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in NESTED)
