"""Readers and writers: records over block borders, carried energies, bad blocks, lists, parameter files, report lines."""

import pytest
from pyspark.sql import functions as F

from lumenspec.functions import molecules as Mol
from lumenspec.functions import spectra as S
from lumenspec.operators import evaluation as E
from lumenspec.operators import matching as M
from lumenspec.operators import relations as K
from lumenspec.sources import libraries as L
from lumenspec.sources import msp, sdf
from lumenspec.sources import parameters as P
from lumenspec.sources import reports as R


def library_text(end):
    """120 records: energies set now and then, notes after peaks, several peaks a line, names right after peaks, odd separators."""
    out, want, energy = [], [], 0
    for i in range(120):
        lines = [f"Name: record {i}", f"ID: r{i}", f"Source: x: {i}"]
        if i % 7 == 3:
            energy = i % 3
            lines.append(f"Comment: Energy{energy} or so")
        n = i % 5
        pairs = [(10.5 + 7 * k, 3.0 + i + k) for k in range(n)]
        lines.append(f"Num Peaks: {n}")
        if i % 4 == 1:
            lines.append("; ".join(f"{m} {x}" for m, x in pairs) or "0;")
        else:
            lines += [f'{m} {x} "C2H5 30 {k}"' for k, (m, x) in enumerate(pairs)]
        if i % 6 == 2:
            lines += ["99 99", "98 98"]  # more peaks than said
        out.append(end.join(lines) + end + ("" if i % 10 == 9 else ["", " ", "--"][i % 3] + end))
        want.append((f"r{i}", f"record {i}", energy, n, f"x: {i}", tuple(pairs)))
    return "".join(out), want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [97, 1000, 1 << 20])
def test_records_over_borders(spark, tmp_path, end, block):
    text, want = library_text(end)
    (tmp_path / "a.msp").write_bytes(text.encode())
    (tmp_path / "b.msp").write_bytes(f"Name: z{end}Num peaks: 1{end}5 5{end}".encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = msp.read_msp(spark, f"file://{tmp_path}/*.msp").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = sorted((r["id"], r["name"], r["energy"], r["num_peaks"], r["params"].get("SOURCE"), tuple(tuple(p) for p in r["peaks"])) for r in rows)
    assert got == sorted([*want, ("z", "z", 0, 1, None, ((5.0, 5.0),))])


def test_records_of_many_kinds(spark, tmp_path):
    (tmp_path / "c.msp").write_text("Name: a\nSMILES: CC\nMW: 12.5\nmass: 3\nMASS: 4\nNum Peaks: 4\n20 1; 10 2;\n20 7\n3000 9\n\nName: b\nSynon: x:y\nNum Peaks: 0\n\nComment: only\n")
    lib = msp.read_msp(spark, f"file://{tmp_path}/c.msp", ordered=False)
    rows = {r["name"]: r for r in lib.collect()}
    assert rows["a"]["params"] == {"NAME": "a", "SMILES": "CC", "MW": "12.5", "MASS": "4"} and rows["a"]["mw"] == 12.5 and rows[None]["num_peaks"] is None
    dense = {r["id"]: r for r in msp.dense_spectra(lib, 30).collect()}
    assert dense["a"]["structure"] == "CC" and dense["b"]["structure"] == "b" and [(i, x) for i, x in enumerate(dense["a"]["vec"]) if x] == [(10, 2.0), (20, 7.0)] and not any(dense["b"]["vec"])
    with pytest.raises(Exception, match="more than one colon"):
        msp.read_msp(spark, f"file://{tmp_path}/c.msp", strict=True).collect()
    notes = spark.createDataFrame([([(50.5, 10.0, [(3, 0.5), (7, 0.2)]), (60.0, 90.0, [])],)], "peaks array<struct<mz:double,intensity:double,notes:array<struct<frag:int,score:double>>>>")
    lines = notes.select(R.annotated_lines(F.col("peaks"))).first()[0]
    assert lines == "50.5 10 3 7 (50.000 20.000)\n60 90"
    back = spark.createDataFrame([(lines,)], "t string").select(msp.peaks_of(F.col("t"))).first()[0]
    assert [tuple(p) for p in back] == [(50.5, 10.0), (60.0, 90.0)]


def block(name, atoms=2, counts=None, props=(), end="\n"):
    head = [name, "", "", counts if counts is not None else f"{atoms:3d}{max(atoms - 1, 0):3d}  0"]
    body = [f"    0.0000    1.5000   -2.0000 C{'lN'[i % 2] if i else ''}  0" for i in range(atoms)] + [f"{i + 1:3d}{i + 2:3d}  1" for i in range(atoms - 1)]
    tags = [x for k, v in props for x in (f"> <{k}>", v, "")]
    return end.join([*head, *body, "M  END", *tags, "$$$$", ""])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 1 << 20])
def test_blocks(spark, tmp_path, end, size):
    fine = [("SMILES", "CC"), ("EXACT MASS", "30.5"), ("MASS SPECTRAL PEAKS", f"10 5{end}29.5 100"), ("PREDICTED SPECTRUM", "7 7")]
    blocks = [
        block("good", props=fine, end=end), block("", props=fine, end=end), block("bad counts", counts=" x  1", props=fine, end=end), block("few lines", counts=" 90 90  0", props=fine, end=end), block("large", atoms=5, props=fine, end=end),
        block("no peaks", props=fine[:2], end=end), block("no structure", props=[("SMILES", " "), *fine[1:]], end=end), block("no mass", props=[fine[0], *fine[2:]], end=end),
        block("ratio", props=[fine[0], ("EXACT MASS", "9"), fine[2]], end=end), block("high", props=[fine[0], ("EXACT MASS", "900"), ("MASS SPECTRAL PEAKS", "1000 1")], end=end), block("twice", props=[*fine, ("SMILES", "CN")], end=end),
    ]
    (tmp_path / "a.sdf").write_bytes("".join(blocks).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        mols = L.read_library(spark, f"file://{tmp_path}/a.sdf")
        good, bad = sdf.sorted_out(mols, max_atoms=4)
        good, bad = good.collect(), bad.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["name"] for r in good) == ["", "good", "twice"] and len(good) + len(bad) == len(blocks)
    assert {r["name"]: r["reason"] for r in bad} == {"bad counts": "unparsable", "few lines": "unparsable", "large": "too many atoms", "no peaks": "no peaks", "no structure": "no structure", "no mass": "no mass", "ratio": "last peak over mass", "high": "last peak too high"}
    one = next(r for r in good if r["name"] == "good")
    assert [tuple(a) for a in one["atoms"]] == [(0.0, 1.5, -2.0, "C"), (0.0, 1.5, -2.0, "CN")] and [tuple(b) for b in one["bonds"]] == [(1, 2, 1)]
    assert [tuple(p) for p in one["peaks"]] == [(10.0, 5.0), (29.5, 100.0)] and next(r for r in good if r["name"] == "twice")["structure"] == "CN"
    assert [tuple(p) for p in sdf.library_of(mols.where("name = 'good'"), predicted=True).first()["peaks"]] == [(7.0, 7.0)]
    assert [tuple(r) for r in sdf.bond_rows(mols.where("name = 'good'")).collect()] == [("good", 1, 2, 1)]


def test_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text("CC\nCN\n\nCO\n")
    assert sorted(r[0] for r in sdf.read_structures(spark, f"file://{tmp_path}/s.txt").collect()) == ["CC", "CN"]
    (tmp_path / "d.csv").write_text("CC,1,,3\nCN,0,2.5\n")
    assert {r["structure"]: r["vec"] for r in sdf.read_dense_csv(spark, f"file://{tmp_path}/d.csv", 5).collect()} == {"CC": [0, 1, 0, 3, 0], "CN": [0, 0, 2.5, 0, 0]}
    (tmp_path / "m.txt").write_text("# a comment\none CC 1\ntwo CN 2\n")
    assert sorted(tuple(r) for r in L.read_pairs(spark, f"file://{tmp_path}/m.txt").collect()) == [("one", "CC", 1), ("two", "CN", 2)]
    (tmp_path / "f.txt").write_text("BreakAtomPair\n RingFeatures \n\nIgnored\n")
    assert P.read_features(spark, f"file://{tmp_path}/f.txt") == ["BreakAtomPair", "RingFeatures"]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(ValueError, match="no features"):
        P.read_features(spark, f"file://{tmp_path}/e.txt")


@pytest.mark.parametrize("every", [1, 9])
def test_parameter_files(spark, every):
    weights = {k: (k - 50) / 7 for k in range(0, 230, every)}
    lines = P.parameter_lines(spark.createDataFrame(list(weights.items()), "place long, weight double"), ["a", "b", "c"], 3, 230)
    texts = [r["text"] for r in lines.orderBy("line").collect()]
    sparse = every == 9
    assert texts[: 4 + sparse] == ["SPARSE"] * sparse + ["3", "a b c", "3", "230"] and len(texts) == (6 + 2 if sparse else 4 + 5)
    assert max(len(t.split()) for t in texts) == (40 if sparse else 50)
    back = P.read_parameters(lines).collect()
    assert {r["place"]: r["weight"] for r in back if r["weight"]} == pytest.approx({k: float(f"{w:.8g}") for k, w in weights.items() if w}) and back[0]["features"] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="announced"):
        P.read_parameters(lines.where(f"line < {len(texts) - 1}"))
    with pytest.raises(ValueError, match="one place"):
        P.parameter_lines(spark.createDataFrame([(1, 1.0), (1, 2.0)], "place long, weight double"), ["a"], 1, 5)


def test_report_lines(spark, tmp_path):
    one = spark.range(1)
    line = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert line(R.answer_line(lit("q"), lit(3), lit(0.5))) == "q:3,0.500000" and line(R.score_line(lit("q"), lit(0.5), lit(1.0))) == "q:0.500000;1.000000"
    assert line(R.ranked_line(lit(1), lit(0.123456789), lit(7), lit("CC"))) == "1 0.12345679 7 CC" and line(R.match_line(lit("CC"), lit("CN"), lit(4))) == "CC CN 4"
    assert line(R.transition_line(lit(0), lit(2), lit("O"))) == "0 2 O"
    text = line(R.sdf_block(lit("mol"), F.create_map(lit("SMILES"), lit("CC"), lit("EXACT MASS"), lit("30"))))
    (tmp_path / "x.sdf").write_text(text + "\n")
    back = sdf.read_sdf(spark, f"file://{tmp_path}/x.sdf").first()
    assert back["name"] == "mol" and back["props"] == {"SMILES": "CC", "EXACT MASS": "30"} and back["atoms"] == []
    mol = spark.createDataFrame([([(0.5, -1.25, 10.0, "C"), (1.0, 0.0, -3.5, "Cl")], [(1, 2, 1)])], "atoms array<struct<x:double,y:double,z:double,symbol:string>>, bonds array<struct<a:int,b:int,order:int>>")
    (tmp_path / "y.sdf").write_text(mol.select(R.sdf_block(lit("m"), F.create_map(lit("SMILES"), lit("CCl"), lit("PREDICTED SPECTRUM"), lit("5 1\n7 2\n5 3")), F.col("atoms"), F.col("bonds"))).first()[0] + "\n")
    again = sdf.read_sdf(spark, f"file://{tmp_path}/y.sdf")
    assert again.select("atoms", "bonds").collect() == mol.collect()
    dense = sdf.dense_of(again, predicted=True, bins=10).first()
    assert dense["structure"] == "CCl" and dense["vec"] == [0, 0, 0, 0, 0, 3, 0, 2, 0, 0]
    rows = spark.createDataFrame([("CC", "01", "a"), ("CN", "11", "b"), ("CO", "00", "a")], "smiles string, fingerprint string, reason string")
    R.write_lines(rows.where("smiles = 'CC'"), "smiles", f"file://{tmp_path}/lines")
    R.write_lines(rows.where("smiles <> 'CC'"), "smiles", f"file://{tmp_path}/lines")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/lines").collect()) == ["CC", "CN", "CO"]
    R.write_fingerprints(rows, f"file://{tmp_path}/fp")
    assert spark.read.csv(f"file://{tmp_path}/fp", header=True).where("smiles = 'CC'").first()["fingerprint"] == "01"
    R.write_counts(rows, "reason", f"file://{tmp_path}/counts")
    assert sorted(tuple(r) for r in spark.read.csv(f"file://{tmp_path}/counts", sep="\t").collect()) == [("a", "2"), ("b", "1")]
    (tmp_path / "bits.txt").write_text("1\t0.9\t0.8\t0.7\t0.6\n2\t0.5\t0.5\t0.5\t0.4\n")
    assert [r["id"] for r in K.usable_models(R.read_bit_metrics(spark, f"file://{tmp_path}/bits.txt")).collect()] == [1]


def test_small_functions(spark):
    p = spark.createDataFrame([([(2.0, 1.0), (1.0, 5.0), (1.0, 7.0), (3.0, 5.0)],)], "p array<struct<mz:double,intensity:double>>")
    r = p.select(S.by_mass(F.col("p")).alias("m"), S.by_intensity(F.col("p")).alias("i")).first()
    assert [tuple(x) for x in r["m"]] == [(1, 7), (1, 5), (2, 1), (3, 5)] and [tuple(x) for x in r["i"]] == [(1, 7), (1, 5), (3, 5), (2, 1)]
    peaks = spark.createDataFrame([(1, 10.0, 1.0), (1, 10.5, 2.0), (1, 20.0, 3.0), (2, 10.0, 4.0)], "spec_id long, mz double, intensity double")
    masses = spark.createDataFrame([(1, 10.1), (1, 19.7)], "spec_id long, mass double")
    assert sorted((x["spec_id"], x["mz"]) for x in S.near_masses(peaks, masses, 0.2, 0).collect()) == [(1, 10.0)]
    assert spark.range(1).select(Mol.one_hot(F.array(F.lit(0), F.lit(2)), 3)).first()[0] == [[1, 0, 0], [0, 0, 1]]
    with pytest.raises(ValueError, match="Cosine"):
        M.scores_by_name(p, ["DotProduct", "Cosine"], 1, 1)
    table = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1)], "k long, v string, w int")
    both = K.merge_first(spark.createDataFrame([(1,), (2,), (3,)], "key long"), table, "key", "k")
    assert sorted((r["key"], r["v"], r["w"]) for r in both.collect()) == [(1, "a", 3), (2, "c", 1), (3, None, None)]
    assert K.merge_first(spark.createDataFrame([(1,)], "key long"), table, "key", "k", ["w"]).first()["v"] == "b"
    scores = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.25), ("n", 0, 1.0)], "id string, energy int, dot double")
    report = {(r["section"], r["place"], r["text"]) for r in E.stats_report(scores, ["dot"], 2).collect()}
    assert report == {("Energy0", 0, "m\t0.500000"), ("Energy0", 0, "n\t1.00000"), ("Energy1", 0, "m\t0.250000"), ("Energy0", 1, "dot (mean, std err): 0.750000 0.125000"), ("Energy1", 1, "dot (mean, std err): 0.250000 0.00000"), ("Totals", 1, "dot (mean, std err): 0.437500 0.0312500")}


def test_listed_and_settings(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2\none CC 1\n\ntwo CN\n")
    assert sorted(tuple(r) for r in L.read_listed(spark, f"file://{tmp_path}/m.txt").collect()) == [("one", "CC", 1), ("two", "CN", None)]
    (tmp_path / "n.txt").write_text("3\none CC 1\n")
    with pytest.raises(ValueError, match="says"):
        L.read_listed(spark, f"file://{tmp_path}/n.txt")
    (tmp_path / "c.txt").write_text("# settings\ndepth 2\nspectrum_depth 1\nspectrum_depth 3\ndepth 4\nflag\n")
    assert L.read_settings(spark, f"file://{tmp_path}/c.txt", {"tol": "0.1", "depth": "9"}, ("spectrum_depth", "weight")) == {"tol": "0.1", "depth": "4", "spectrum_depth": ["1", "3"], "weight": []}


def test_graph_lines(spark):
    f = spark.createDataFrame([("m", k, 10.0 + k, f"C{k}") for k in range(4)], "mol string, frag long, mass double, structure string")
    t = spark.createDataFrame([("m", 0, 1, "O"), ("m", 1, 2, "H"), ("m", 0, 3, "N")], "mol string, src long, dst long, loss string")
    told = lambda rows: [r["text"] for r in rows.orderBy("part", "place").collect()]
    assert told(R.graph_lines(f, t)) == ["4", "0 10 C0", "1 11 C1", "2 12 C2", "3 13 C3", "", "0 1 O", "0 3 N", "1 2 H"]
    belief = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 0.25), ("m", 2, 0.1)], "mol string, frag long, belief double")
    assert told(R.graph_lines(f, t, belief, 0.2)) == ["2", "0 10 C0 1", "1 11 C1 0.25", "", "0 1 O"]


def test_batches_and_limits(spark):
    keys = spark.range(200).withColumnRenamed("id", "key")
    parts = [{r["key"] for r in E.mini_batch(keys, "key", k, 4).collect()} for k in range(4)]
    assert set().union(*parts) == set(range(200)) and sum(map(len, parts)) == 200 and min(map(len, parts)) > 20
    atoms = spark.createDataFrame([(1, [("C", 2), ("H", 6)]), (2, [("Xx", 1)]), (3, [("C", 200)])], "id int, atoms array<struct<element:string,n:int>>")
    got = atoms.select("id", Mol.acceptable(F.col("atoms"), {"C": 12.0, "H": 1.0}, ["C", "H", "Xx"]).alias("ok")).collect()
    assert {r["id"]: r["ok"] for r in got} == {1: True, 2: False, 3: False}
