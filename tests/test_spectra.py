"""Golden values of alignment scores, quantising and text libraries."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspec.functions import spectra as S
from lumenspec.operators import matching as M
from lumenspec.sources import libraries as L

MEASURED = [[(50, 100)], [(10, 20), (40, 30), (60, 35), (76, 5), (76.43, 5), (76.8, 5)], [(40, 50), (60, 50)]]
PREDICTED = [[(50, 40), (60, 30)], [(10, 20), (50.99, 20), (60, 35), (76.008, 5), (76.31, 5), (76.431, 5), (76.432, 10)], [(40, 100), (43, 80)]]
GOLD = {"weighted_recall": (100, 65, 50), "recall": (100, 66.6666667, 50), "precision": (50, 57.1428571, 50), "weighted_precision": (57.1428571, 70, 55.5555556), "jaccard": (0.6666667, 0.6153846, 0.5)}


def arrays(peaks):
    a = np.array(peaks, float)
    return a[:, 0], a[:, 1] * 100 / a[:, 1].sum()


@pytest.mark.parametrize("k", range(3))
def test_scores(k):
    p, q = arrays(MEASURED[k]), arrays(PREDICTED[k])
    got = M.pair_scores(*p, *q, M.align(*p, *q, 0.01, 10))
    for name, values in GOLD.items():
        assert got[name] == pytest.approx(values[k], abs=1e-6)


def test_alignment_is_best():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, m = r.integers(0, 5, 2)
        p, q = (np.sort(r.integers(0, 8, k)).astype(float) for k in (n, m))
        a, b = r.random(n), r.random(m)
        ok = [(i, j) for i in range(n) for j in range(m) if abs(p[i] - q[j]) < 1.1]
        value = lambda s: sum(a[i] * b[j] + 1 for i, j in s)
        best = max(value(s) for k in range(len(ok) + 1) for s in combinations(ok, k) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(s, s[1:])))
        got = M.align(p, a, q, b, 1.1, 0)
        assert value(got) == pytest.approx(best) and set(got) <= set(ok)


def test_quantise(spark):
    df = spark.createDataFrame([(1, float(m), float(i)) for m, i in PREDICTED[1]], "spec_id int, mz double, intensity double")
    got = {d: {round(r["mz"], 6): round(r["intensity"], 9) for r in S.quantise(df, d).collect()} for d in (2, 0)}
    assert len(got[2]) == 6 and got[2][76.43] == 15
    assert got[0] == {10: 20, 51: 20, 60: 35, 76: 25}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, None), (3, None, 2.0)], "spec_id int, mz double, intensity double")
    assert S.normalize(df).count() == 3 and S.bin_integer(df.limit(0)).count() == 0
    assert S.keep_most_intense(df).count() == 3


def test_msp(spark, tmp_path):
    (tmp_path / "a.msp").write_text("NAME: x\nID: one\nMW: 12.5\nComment: Energy1\nNum Peaks: 2\n50.5 10\n60 90\n\nName: y\nFP: 0110\nnum peaks: 3\n1 2; 3 4;\n5 6\n\n")
    a, b = L.read_msp(spark, str(tmp_path / "a.msp")).orderBy("name").collect()
    assert (a["id"], a["energy"], a["mw"], a["num_peaks"]) == ("one", 1, 12.5, 2) and [tuple(p) for p in a["peaks"]] == [(50.5, 10.0), (60.0, 90.0)]
    assert (b["id"], b["energy"], b["fp"]) == ("y", 1, "0110") and [tuple(p) for p in b["peaks"]] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_peak_lists_and_sdf(spark, tmp_path):
    (tmp_path / "p.txt").write_text("low\n10 20\n11 5\nhigh\n12 7\n")
    got = L.read_peak_lists(spark, str(tmp_path / "p.txt")).orderBy("energy").collect()
    assert [len(r["peaks"]) for r in got] == [2, 1]
    (tmp_path / "m.sdf").write_text("mol\n\n\n  0  0\nM  END\n> <SMILES>\nCC\n\n> <EXACT MASS>\n30.05\n\n$$$$\n")
    r = L.read_sdf(spark, str(tmp_path / "m.sdf")).first()
    assert r["name"] == "mol" and r["props"] == {"SMILES": "CC", "EXACT MASS": "30.05"}


def test_band_join(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 5.5), (3, None)], "i int, x double")
    b = spark.createDataFrame([(1, 2.0), (2, 2.1), (3, 5.0)], "j int, y double")
    assert sorted((r["i"], r["j"]) for r in M.band_join(a, b, "x", "y", 1.0).collect()) == [(1, 1), (2, 3)]
