"""Graphs of atoms, rules, fitted beliefs, models and the search of a whole library, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspec.functions import molecules as Mol
from lumenspec.operators import annotation as N
from lumenspec.operators import evaluation as E
from lumenspec.operators import fitting as Fit
from lumenspec.operators import matching as M
from lumenspec.operators import ranks
from lumenspec.operators import relations as R
from lumenspec.operators import studies as T
from lumenspec.operators import graphs as G
from lumenspec.operators import models as L
from lumenspec.operators import rules as Rules
from lumenspec.operators.search import search_all

ring = lambda *a: list(zip(a, (*a[1:], a[0])))
MOLECULES = {
    "chain": [(1, 2), (2, 3), (3, 4), (3, 5)], "triangle": ring(1, 2, 3), "naphthalene": ring(1, 2, 3, 4, 5, 6) + ring(5, 6, 7, 8, 9, 10)[1:], "spiro": ring(1, 2, 3, 4) + ring(4, 5, 6, 7, 8),
    "norbornane": ring(1, 2, 3, 4, 5, 6) + [(1, 7), (7, 4)], "cubane": ring(1, 2, 3, 4) + ring(5, 6, 7, 8) + [(1, 5), (2, 6), (3, 7), (4, 8)], "adamantane": ring(1, 2, 3, 4, 5, 6) + [(1, 7), (3, 8), (5, 9), (7, 10), (8, 10), (9, 10)],
    "two": ring(1, 2, 3) + ring(11, 12, 13, 14, 15, 16, 17, 18), "large": ring(*range(1, 11)), "bicyclooctane": ring(1, 2, 3, 4, 5, 6) + [(1, 7), (7, 8), (8, 4)],
}
_r = np.random.default_rng(2)
for _k in range(12):
    MOLECULES[f"random {_k}"] = [(int(a), int(b)) for a, b in _r.integers(1, 9, (11, 2))]


def all_cycles(bonds, most=8):
    """Every cycle as its set of bonds, by walking from each atom over larger ones."""
    near = {}
    for a, b in bonds:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = set()

    def walk(path):
        for x in near[path[-1]]:
            if x == path[0] and len(path) > 2:
                found.add(frozenset(frozenset(p) for p in zip(path, path[1:] + path[:1])))
            elif x > path[0] and x not in path and len(path) < most:
                walk([*path, x])

    for a in near:
        walk([a])
    return found


def rank_of(cycles):
    """The rank over GF(2) of cycles as sets of bonds."""
    pivots = []
    for c in cycles:
        c = set(c)
        for p, lead in pivots:
            if lead in c:
                c ^= p
        if c:
            pivots.append((c, next(iter(c))))
    return len(pivots)


def bond_table(spark):
    rows = [(m, a, b) for m, bonds in MOLECULES.items() for a, b in bonds]
    return spark.createDataFrame(rows + [(m, b, a) for m, a, b in rows[:5]], "mol string, a int, b int")


def bonds_of(atoms):
    return frozenset(frozenset(p) for p in zip(atoms, atoms[1:] + atoms[:1]))


def test_rings(spark):
    bonds = bond_table(spark)
    got: dict = {}
    found = G.rings(bonds).cache()
    for r in found.collect():
        assert r["size"] == len(r["atoms"]) == len(set(r["atoms"]))
        got.setdefault(r["mol"], []).append(list(r["atoms"]))
    for mol, edges in MOLECULES.items():
        cycles = all_cycles(edges)
        mine = got.get(mol, [])
        assert all(bonds_of(a) in cycles for a in mine) and rank_of([bonds_of(a) for a in mine]) == len(mine) == rank_of(sorted(cycles, key=len))
        for size in range(3, 9):  # as many small ones as are independent: no basis has smaller rings
            assert sum(len(a) <= size for a in mine) == rank_of([c for c in cycles if len(c) <= size]), (mol, size)
    assert sorted(len(a) for a in got["cubane"]) == [4] * 5 and sorted(len(a) for a in got["norbornane"]) == [5, 5] and "large" not in got and sorted(len(a) for a in got["two"]) == [3, 8]
    census = {r["mol"]: r for r in G.ring_census(found).collect()}
    assert census["naphthalene"]["sizes"] == {6: 2} and (census["naphthalene"]["shared_atoms"], census["naphthalene"]["shared_bonds"]) == (2, 1) and (census["spiro"]["shared_atoms"], census["spiro"]["shared_bonds"]) == (1, 0)


def test_bridges(spark):
    bonds = bond_table(spark)
    found = G.rings(bonds).cache()
    by: dict = {}
    for r in found.collect():
        by.setdefault(r["mol"], {})[r["ring"]] = list(r["atoms"])
    atoms, several, shared, heads = set(), set(), set(), set()
    for mol, rings in by.items():
        near = {frozenset(b) for b in MOLECULES[mol]}
        seen: list = []
        for i, j in itertools.combinations(sorted(rings), 2):
            both = set(rings[i]) & set(rings[j])
            if len(both) > 2:
                seen += [(mol, x) for x in both]
                heads |= {(mol, x) for x in both if sum(frozenset((x, y)) in near for y in both if y != x) == 1}
            bonds_both = bonds_of(rings[i]) & bonds_of(rings[j])
            if len(bonds_both) > 1:
                shared |= {(mol, *sorted(b)) for b in bonds_both}
        atoms |= set(seen)
        several |= {x for x in seen if seen.count(x) > 1}
    bridged = G.bridges(found)
    got = G.bridge_atoms(bridged).collect()
    assert {(r["mol"], r["atom"]) for r in got} == atoms and {(r["mol"], r["atom"]) for r in got if r["several"]} == several and len(got) == len(atoms)
    assert {tuple(r) for r in G.bridge_bonds(found).collect()} == shared and {tuple(r) for r in G.bridge_heads(bridged, bonds).collect()} == heads
    assert {("norbornane", 1), ("norbornane", 4)} <= heads and several and not any(m == "naphthalene" for m, _ in atoms)


def test_connected_tuples(spark):
    r = np.random.default_rng(9)
    hydrogens = [(m, 100 + k, int(t)) for m in list(MOLECULES)[:14] for k, t in enumerate(r.choice(sorted({x for b in MOLECULES[m] for x in b}), 6))]
    want = set()
    for m in {h[0] for h in hydrogens}:
        near = {frozenset(b) for b in MOLECULES[m]}
        own = [(h, t) for mol, h, t in hydrogens if mol == m]
        for n in range(1, 5):
            for choice in itertools.permutations(own, n):
                left, reached = {t for _, t in choice[1:]} - {choice[0][1]}, {choice[0][1]}
                while more := {x for x in left if any(frozenset((x, y)) in near for y in reached)}:
                    reached, left = reached | more, left - more
                if not left:
                    want.add((m, tuple(h for h, _ in choice)))
    got = [(x["mol"], tuple(x["tuple"])) for x in G.connected_tuples(spark.createDataFrame(hydrogens, "mol string, h int, target int"), bond_table(spark), 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rules(spark):
    mols = spark.createDataFrame([(k,) for k in range(6)], "id int")
    values = spark.createDataFrame([(0, "x", 5.0), (1, "x", 1.0), (1, "y", 9.0), (2, "x", float("nan")), (3, "x", 5.0), (3, "spare", 1.0), (4, "y", None), (5, "x", 5.0), (5, "y", 9.0), (5, "spare", 0.0)], "id int, column string, value double")
    rules = spark.createDataFrame([(3, "x high", "x", ">", 4.0, "spare"), (1, "y nine", "y", "=", 9.0, None), (2, "x low", "x", "<=", 1.0, None)], Rules.RULES)
    first = Rules.first_failures(mols, values, rules, "id")
    assert {r["id"]: r["reason"] for r in first.collect()} == {0: "x high", 1: "y nine", 2: None, 3: None, 4: None, 5: "y nine"}
    assert {r["reason"]: r["n"] for r in Rules.reasons(first).collect()} == {"x high": 1, "y nine": 2, None: 3}
    with pytest.raises(Exception, match="no comparison"):
        Rules.failures(values, spark.createDataFrame([(1, "odd", "x", "~", 4.0, None)], Rules.RULES), "id").collect()


def walks(edges, depth):
    """(start row vector, step matrix) of a molecule of few nodes."""
    n = 1 + max(max(e[:2]) for e in edges)
    w = np.zeros((n, n))
    for a, b, p in edges:
        w[a, b] = p
    w[np.arange(n), np.arange(n)] += 1 - w.sum(1)
    return np.eye(n)[0], w


def plain_fit(edges, targets, depth, rounds, retries=3, least=1e-3, swing=0.999):
    """Proportional fitting in dense arrays, with the same rules."""
    start, w = walks(edges, depth)
    n, steps = len(start), sorted(targets)

    def marginals(f):
        down, up = [start], [np.ones(n)]
        for k in range(depth):
            down.append((down[-1] * f[k]) @ w)
            up.append(w @ (up[-1] * f[depth - k]))
        b = [d * f[k] * up[depth - k] for k, d in enumerate(down)]
        return [x / x.sum() for x in b]

    def sweep(goal, forward):
        f, before = np.ones((depth + 1, n)), None
        for k in range(1, rounds + 1):
            off = []
            for s in steps if forward else steps[::-1]:
                m = marginals(f)[s]
                t = np.where(m > 0, goal[s], 0)
                t = t / t.sum()
                off.append(np.abs(t - m).sum())
                f[s] *= np.divide(t, m, out=np.zeros(n), where=m > 0)
            if max(off) < least:
                return f, "converged", k
            if before is not None and all(o > swing * b > 0 for o, b in zip(off, before)):
                return f, "swinging", k
            before = off
        return f, "not converged", rounds

    f, state, k = sweep(targets, True)
    for retry in range(retries):
        if state != "swinging":
            break
        back, _, _ = sweep(targets, False)
        targets = {s: (marginals(f)[s] + marginals(back)[s]) / 2 for s in steps}
        f, state, k = sweep(targets, True)
        state = "converged after averaging" if state == "converged" else state
    return marginals(f), "not converged" if state == "swinging" else state, k


def test_fit(spark):
    tree = [(0, 1, 0.3), (0, 2, 0.3), (1, 3, 0.5), (2, 3, 0.2), (2, 4, 0.4)]
    cases = {
        "one": {2: [1, 1, 1, 2, 3]}, "two": {1: [0.4, 0.3, 0.3, 0, 0], 2: [0.16, 0.25, 0.2, 0.25, 0.14]}, "swing": {1: [0.0, 0.9, 0.1, 0, 0], 2: [0.0, 0.1, 0.1, 0.1, 0.7]},
        "clash": {1: [0.8, 0.1, 0.1, 0, 0], 2: [0.1, 0.1, 0.1, 0.3, 0.4]}, "lost": {1: [0.5, 0.5, 0, 0, 9.0]}, "late": {3: [0, 0, 0, 1, 1]},
    }
    args = {"rounds": 5, "retries": 1, "least": 0.1, "swing": 0.99}
    edges = spark.createDataFrame([(m, a, b, math.log(p)) for m in cases for a, b, p in tree], "mol string, src long, dst long, log_p double")
    start = spark.createDataFrame([(m, 0, 1.0) for m in cases], "mol string, node long, p double")
    targets = spark.createDataFrame([(m, s, k, float(p)) for m, t in cases.items() for s, ps in t.items() for k, p in enumerate(ps)], "mol string, step int, node long, p double")
    beliefs, status = Fit.fitted(edges, start, targets, 3, **args)
    got: dict = {}
    for r in beliefs.collect():
        got.setdefault((r["mol"], r["step"]), np.zeros(5))[r["node"]] = r["belief"]
    ends = {r["mol"]: (r["status"], r["rounds"]) for r in status.collect()}
    for m, t in cases.items():
        want, state, k = plain_fit(tree, {s: np.array(p, float) for s, p in t.items()}, 3, **args)
        assert ends[m] == (state, k), m
        for s in range(4):
            assert got[m, s] == pytest.approx(want[s], abs=1e-9), (m, s)
    assert {m: s for m, (s, _) in ends.items()} == {"one": "converged", "two": "converged", "swing": "converged after averaging", "clash": "not converged", "lost": "converged", "late": "converged"}


def test_predicted_spectra(spark):
    beliefs = spark.createDataFrame([("m", 1, 0, 0.25), ("m", 1, 1, 0.75), ("m", 2, 1, 1.0), ("m", 2, 2, 0.0)], "mol string, step int, node long, belief double")
    patterns = spark.createDataFrame([("m", 0, 10.0, 0.8), ("m", 0, 11.0, 0.2), ("m", 1, 11.00000000000001, 1.0)], "mol string, node long, mz double, share double")
    got = {(r["energy"], r["mz"]): r["intensity"] for r in Fit.predicted_spectra(beliefs, patterns, spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "energy int, step int")).collect()}
    assert got == pytest.approx({(0, 10.0): 20.0, (0, 11.0): 80.0, (1, 11.0): 100.0, (2, 11.0): 100.0})


def test_components(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 12)) @ r.standard_normal((12, 12)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(7)
    mean, parts, variance = L.principal_components(df, k=3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = vt[:3] * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]
    assert mean == pytest.approx(x.mean(0), abs=1e-9) and parts == pytest.approx(want, abs=1e-9) and variance == pytest.approx(s[:3] ** 2 / 299, rel=1e-9)
    got = {q["id"]: q["xy"] for q in df.select("id", L.projected(F.col("vec"), mean, parts).alias("xy")).collect()}
    assert np.array([got[i] for i in range(300)]) == pytest.approx((x - x.mean(0)) @ want.T, abs=1e-9)
    with pytest.raises(ValueError, match="length"):
        L.principal_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, vec array<double>"))


def labelled(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 5))
    y = (x @ r.standard_normal((5, 7)) + r.standard_normal((400, 7)) + np.linspace(-1, 1, 7) > 0).astype(int)
    return x, y, spark.createDataFrame([(v.tolist(), b.tolist()) for v, b in zip(x, y)], "vec array<double>, bits array<int>").repartition(5)


def test_logistic(spark):
    x, y, df = labelled(spark)
    got, rounds = L.logistic(df, least=1e-7)
    z, ridge = np.c_[x, np.ones(400)], np.diag([1.0] * 5 + [0])
    for k in range(7):
        w = np.zeros(6)
        for _ in range(30):  # Newton's method
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y[:, k]) + ridge @ w)
        assert got[k] == pytest.approx(w, abs=1e-4)
    assert len(set(rounds)) > 1 and rounds.max() <= 300
    bits = df.select("vec", L.scored_bits(F.col("vec"), got, 0.0).alias("b")).collect()
    assert all(q["b"] == (np.append(q["vec"], 1) @ got.T > 0).astype(int).tolist() for q in bits)


@pytest.mark.parametrize("components", [1, 3, 9])
def test_partial_least_squares(spark, components):
    x, y, df = labelled(spark)
    got = L.least_squares_components(df, components=components)
    for k in range(7):
        e, f = x - x.mean(0), y[:, k] - y[:, k].mean()
        ws, ps, qs = [], [], []
        for _ in range(min(components, 5)):  # deflating the rows themselves
            w = e.T @ f / np.linalg.norm(e.T @ f)
            t = e @ w
            p, q = e.T @ t / (t @ t), f @ t / (t @ t)
            e, f = e - np.outer(t, p), f - q * t
            ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
        w, p = np.array(ws).T, np.array(ps).T
        want = w @ np.linalg.solve(p.T @ w, np.array(qs))
        assert got[k, :5] == pytest.approx(want, abs=1e-6) and got[k, 5] == pytest.approx(y[:, k].mean() - want @ x.mean(0), abs=1e-6)


def test_chosen_components(spark):
    x, y, df = labelled(spark)
    got, number = L.chosen_components(df, df, least=1, most=5)
    fits = [L.least_squares_components(df, components=k) for k in range(1, 6)]
    right = np.array([((np.c_[x, np.ones(400)] @ w.T > 0.5) == y).sum(0) for w in fits])
    assert (number == right.argmax(0) + 1).all() and got == pytest.approx(np.array([fits[k - 1][j] for j, k in enumerate(number)]), abs=1e-12)


def test_filled_isotopes(spark):
    rows = spark.createDataFrame([("S", 31.97, 0.95), ("S", 32.97, 0.0076), ("S", 33.97, 0.0422), ("S", 35.97, 0.0002), ("Se", 73.92, 0.9), ("X", None, 1.0)], "element string, mass double, area double")
    got = [(r["element"], r["place"], round(r["mass"], 2), r["area"]) for r in Mol.filled_isotopes(rows).orderBy("element", "place").collect()]
    assert got == [("S", 0, 31.97, 0.95), ("S", 1, 32.97, 0.0076), ("S", 2, 33.97, 0.0422), ("S", 3, 34.97, 0.0), ("S", 4, 35.97, 0.0002), ("Se", 0, 73.92, 0.9)]


@pytest.mark.parametrize("top_n, shared", [(3, False), (0, False), (0, True)])
def test_search_all(spark, monkeypatch, top_n, shared):
    import lumenspec.operators.search as search

    monkeypatch.setattr(search, "PEAKS", 150)
    monkeypatch.setattr(search, "ANALYTES", 7)
    r = np.random.default_rng(5)
    spectra = {i: {int(m): float(r.integers(0, 9)) for m in r.choice(25, r.integers(1, 7), replace=False)} for i in range(140)}
    bits = {i: sorted(int(b) for b in r.choice(90, r.integers(0, 20), replace=False)) for i in range(140) if i % 4}
    rows = spark.createDataFrame([(i, m, x) for i, p in spectra.items() for m, x in p.items()], "spec_id long, mz int, intensity double")
    prints = spark.createDataFrame(list(bits.items()), "spec_id long, set array<int>")
    got: dict = {}
    for q in search_all(rows.where("spec_id < 20"), rows.where("spec_id >= 20"), prints, 9, top_n, shared).collect():
        got.setdefault(q["analyte"], []).append((q["rank"], q["lib"], q["score"]))
    top = lambda p: {m for m, _ in sorted(p.items(), key=lambda x: (-x[1], x[0]))[:top_n]}
    for a in range(20):
        scored = []
        for b in range(20, 140):
            p, q = spectra[a], spectra[b]
            if shared and not set(p) & set(q):
                continue
            dot = sum(math.sqrt(p[m] * m) * math.sqrt(q[m] * m) for m in set(p) & set(q))
            whole = sum(x * m for m, x in p.items()) * sum(x * m for m, x in q.items())
            s = dot * dot / whole if whole else 0.0
            if top_n:
                s = math.sqrt(s * len(top(p) & top(q)) / len(top(p) | top(q)))
            if a in bits and b in bits and set(bits[a]) | set(bits[b]):
                s = 0.7 * s + 0.3 * len(set(bits[a]) & set(bits[b])) / len(set(bits[a]) | set(bits[b]))
            scored.append((round(s, 6), b))
        want = sorted(scored, key=lambda x: (-x[0], x[1]))[:9]
        mine = sorted(got.get(a, []))
        assert [x[0] for x in mine] == list(range(1, len(want) + 1)) and [x[2] for x in mine] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert {b for _, b, s in mine if s > mine[-1][2] + 2e-6} == {b for s, b in want if s > want[-1][0] + 2e-6}
    assert search_all(rows.limit(0), rows, prints).count() == 0


def test_evidence_says_when_it_stops(spark):
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(9)], "mol long, src long, dst long")
    sure = spark.createDataFrame([(1, i, 1.0) for i in range(10)], "mol long, node long, belief double")
    none = spark.createDataFrame([(1, 99)], "mol long, node long")
    with pytest.raises(RuntimeError, match="dead ends"):
        N.evidence(chain, sure, 0.1, none, rounds=3)
    assert N.evidence(chain, sure, 0.1, none).count() == 0


def test_blocks_give_what_pairs_give(spark, monkeypatch):
    """Counts and lists from blocks against the functions on all pairs, with ties, repeated ids, missing answers and zero vectors."""
    monkeypatch.setattr(M, "QUERY_BLOCK", 3)
    monkeypatch.setattr(M, "LIBRARY_BLOCK", 17)
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (90, 4)).astype(float)
    x[5] = 0
    v = spark.createDataFrame([(i, int(i % 4), bool(i % 3), a.tolist()) for i, a in enumerate(x)] + [(8, 0, True, x[9].tolist())], "id long, label int, measured boolean, vec array<double>").cache()
    a = v.where("id % 9 = 0 or id = 5").select(F.col("id").alias("query"), F.when(F.col("id") == 81, 1000).otherwise(F.col("id") + 8 - F.col("id") % 5).alias("answer"), F.col("label").alias("query_key"), "vec")
    b = v.select(F.col("id").alias("lib"), F.col("label").alias("lib_key"), "measured", "vec")
    pairs = M.block_scores(a, b, M.cosines).withColumn("score", F.round("score", 6)).cache()
    rows = lambda df, *c: sorted((tuple(q[k] for k in c) for q in df.collect()), key=repr)
    counts = ranks.answer_counts(a, b, M.cosines).cache()
    assert rows(counts.select("query", (F.col("better") + 1).alias("rank"), "candidates"), "query", "rank", "candidates") == rows(T.study_ranks(pairs), "query", "rank", "candidates") != []
    assert rows(counts.select("query", F.round(R.position(F.col("better"), F.col("worse"), F.col("candidates")), 6).alias("p")), "query", "p") == rows(R.ranking_position(pairs), "query", "position")
    assert rows(ranks.best_rows(a, b, M.cosines, 1, columns=("lib_key",)), "query", "lib", "lib_key") == rows(T.best_match(pairs), "query", "lib", "lib_key")
    found = ranks.best_rows(ranks.with_truth(a, b, M.cosines).where("truth is not null"), b, M.cosines, 6, above_truth=True)
    assert rows(found, "query", "rank", "lib", "score") == rows(T.better_than_answer(pairs, 6), "query", "place", "lib", "score")
    for enough in (0.5, 0.98, 2.0):
        assert rows(ranks.tiered_answers(a, b, M.cosines, enough), "query", "tier", "rank", "score") == rows(T.tiered_ranks(pairs, enough), "query", "tier", "rank", "score")
    assert rows(ranks.best_places(a, b, M.cosines), "query", "best") == rows(E.key_ranks(pairs), "query", "best")
    assert rows(ranks.counts_above(a, b, M.cosines, 0.7), "query", "similar") == rows(M.block_scores(a, b, M.cosines).groupBy("query").agg(F.count_if(F.col("score") > 0.7).alias("similar")), "query", "similar")
    answers = a.select(F.col("query").alias("_q"), "answer")
    assert set(rows(E.rank_of_answers(pairs.drop("answer"), answers), "query")) == set(rows(counts, "query"))


def test_places_from_packed_lists(spark, monkeypatch):
    """Lists of ranges of the library against ranks of all pairs as rows, with many ties over ranges, a zero vector and repeated ids."""
    monkeypatch.setattr(ranks, "LIBRARY_BLOCK", 17)
    monkeypatch.setattr(ranks, "PLACES_BLOCK", 3)
    x = np.random.default_rng(4).integers(0, 3, (90, 4)).astype(float)
    x[5] = 0
    again = [(8, 0, x[9].tolist()), (18, 2, x[20].tolist())]
    v = spark.createDataFrame([(i, int(i % 4), a.tolist()) for i, a in enumerate(x)] + again, "id long, label int, vec array<double>").cache()
    a = v.where("id % 9 = 0 or id = 5").select(F.col("id").alias("query"), F.when(F.col("id") == 81, 7).otherwise(F.col("label")).alias("query_key"), "vec")
    b = v.select(F.col("id").alias("lib"), F.col("label").alias("lib_key"), "vec").repartition(5)
    pairs = M.block_scores(a, b, M.cosines).withColumn("score", F.round("score", 6))
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "best", "worst", "mean").collect())
    found = rows(ranks.key_places(a, b, M.cosines))
    assert found == rows(E.key_ranks(pairs)) and len(found) == 10
    falling = np.array([70000, 300, 300, -5, -(1 << 30)], np.int32)
    assert (ranks.unpacked(ranks.packed(falling)) == falling).all() and len(ranks.unpacked(ranks.packed(falling[:0]))) == 0
    assert ranks.half_away(np.array([0.0000005, -0.0000015, 0.2, np.nan])).tolist() == [1, -2, 200000, -(1 << 30)]


def test_windowed_answers(spark, monkeypatch):
    """Parts of cells against all pairs, with half of the masses in one cell."""
    monkeypatch.setattr(ranks, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ranks, "LIBRARY_BLOCK", 11)
    r = np.random.default_rng(8)
    x, mass = r.integers(0, 4, (120, 3)).astype(float), np.where(r.random(120) < 0.5, 7.25, r.uniform(0, 60, 120))
    df = spark.createDataFrame([(i, float(m), v.tolist()) for i, (m, v) in enumerate(zip(mass, x))], "lib long, mass double, vec array<double>")
    a = df.where("lib % 6 = 0").select(F.col("lib").alias("query"), ((F.col("lib") * 7 + 1) % 120).alias("answer"), "mass", "vec")
    score = lambda p, q: M.cosines(*[np.stack(d["vec"].to_numpy()).astype(float) for d in (p, q)])
    got = {q["query"]: (q["rank"], q["candidates"]) for q in ranks.windowed_answers(a, df, score, 4.0).collect()}
    s, want = np.round(M.cosines(x, x), 6), {}
    for i in range(0, 120, 6):
        near = [j for j in range(120) if j != i and abs(mass[i] - mass[j]) < 4]
        if (i * 7 + 1) % 120 in near:
            want[i] = (1 + sum(s[i, j] > s[i, (i * 7 + 1) % 120] for j in near), len(near))
    assert got == want and len(want) > 3
