"""What a query broadcasts, writes or holds must not grow faster than its tables: plans, and steps against plain recomputation."""

import re

import __spark_entry__

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_broadcast_only_rules(spark):
    plan = plan_of(__spark_entry__.queries()["first_failed_rule"](spark, SF))
    assert len(re.findall(r"BroadcastExchange", plan)) == 1 and "BroadcastNestedLoopJoin" not in plan


def all_pairs(spark, name):
    ids = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    want = {(q, x) for q in ids if q % 100 == 0 for x in ids if x != q}
    return len(rows) == len(want) and {(r["query"], r["lib"]) for r in rows} == want


def test_fp_jaccard_gives_every_pair(spark):
    assert all_pairs(spark, "fp_jaccard")


def test_simple_matching_gives_every_pair(spark):
    assert all_pairs(spark, "simple_matching")


def test_search_in_parts_and_cells(spark, monkeypatch):
    """Small parts, cells and blocks give what one block gives, with and without a window; the library goes to each block of analytes once."""
    import numpy as np

    from lumenspec.operators import search

    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(i), int(m), float(r.integers(1, 4))) for i in range(300) for m in r.integers(1, 40, 4)], "spec_id long, mz int, intensity double").groupBy("spec_id", "mz").sum("intensity").withColumnRenamed("sum(intensity)", "intensity").cache()
    masses = spark.createDataFrame([(i, float(r.choice([5.0, 20 * r.random()]))) for i in range(300)], "spec_id long, mass double").cache()
    bits = spark.createDataFrame([(i, [int(x) for x in np.unique(r.integers(0, 70, 5))]) for i in range(0, 300, 7)], "spec_id long, set array<int>").cache()

    def found():
        a, b = rows.where("spec_id % 10 = 0"), rows.where("spec_id % 10 <> 0")
        return [sorted((x["analyte"], x["rank"], x["lib"], x["score"]) for x in search.search_all(a, b, bits, 9, n, shared, m, 1.5).collect()) for n, shared, m in ((10, False, None), (0, True, None), (10, False, masses), (0, True, masses))]

    whole = found()
    assert len(whole[0]) == 30 * 9 and all(whole)
    for name, value in (("PART", 50), ("PEAKS", 300), ("CELL_PEAKS", 40), ("ANALYTES", 7), ("MOST_ANALYTES", 11)):
        monkeypatch.setattr(search, name, value)
    assert found() == whole


def test_window_search_has_no_pairs_of_a_window(spark):
    for name in ("smsf_topk_window", "cosine_fp_topk_window", "match_topk_mass_window"):
        plan = plan_of(__spark_entry__.queries()[name](spark, SF))
        assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_rings_in_one_pass(spark):
    from lumenspec.operators import graphs as G

    bonds = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (None, 2, 0), (1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 3, 0), (2, 0, 1), (2, 1, 0), (2, 2, 2)], "mol int, a int, b int")
    found = G.rings(bonds)
    assert found.schema["mol"].dataType.simpleString() == "int"
    assert sorted(tuple(x) for x in found.collect()) == [(1, 0, 3, [0, 1, 2]), (1, 1, 3, [0, 2, 3])]
    for name in ("ring_numbers", "ring_census", "bridged_rings"):
        plan = plan_of(__spark_entry__.queries()[name](spark, SF))
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" not in plan


def test_tasks_grow_with_peaks(spark, monkeypatch):
    from lumenspec.functions import spectra as S

    monkeypatch.setattr(S, "TASK_ROWS", 100, raising=False)
    p = spark.range(6000).selectExpr("id % 900 as spec_id", "id * 1.0 as mz", "1.0D as intensity")
    for made in (S.quantise(p, 2), S.postprocess(p)):
        assert made.rdd.getNumPartitions() >= 60


def test_batch_scores_are_pair_scores():
    import numpy as np
    import pytest

    from lumenspec.operators import matching as M

    r = np.random.default_rng(3)
    spectrum = lambda n: (np.sort(r.choice([r.random() * 20, 5.0, 6.0], n) if n else np.zeros(0)) + np.arange(n), r.integers(0, 4, n).astype(float))
    rows = [(*spectrum(int(r.integers(0, 25))), *spectrum(int(r.integers(0, 25)))) for _ in range(300)]
    for absolute, ppm in ((1.1, 0), (0.01, 90000)):
        pairs = [M.align(*x, absolute, ppm) for x in rows]
        assert [M.align_small(*[v.tolist() for v in x], absolute, ppm) for x in rows] == pairs
        got = M.batch_scores(*[[v.tolist() for v in c] for c in zip(*rows)], pairs)
        for i, (x, p) in enumerate(zip(rows, pairs)):
            assert {k: v[i] for k, v in got.items()} == pytest.approx(M.pair_scores(*x, p))


def test_tasks_of_large_tables_hold_no_more_than_those_of_small_ones(spark):
    from lumenspec.functions import spectra as S

    most = []
    for n in (300_000, 2_400_000):
        p = spark.range(n).selectExpr("id % (id div 7 + 1) as spec_id", "id * 1.0 as mz", "1.0D as intensity")
        most.append(n / S.quantise(p, 0).rdd.getNumPartitions())
    assert most[1] <= 300_000 and most[1] <= 4 * most[0]


def test_key_ranks_write_no_pairs(spark):
    """A pair of dense_key_ranks is neither a row of a written table nor of a window."""
    plan = plan_of(__spark_entry__.queries()["dense_key_ranks"](spark, SF))
    assert "Window" not in plan and "score" not in plan


def test_band_pairs_in_small_lists(spark):
    """Lists of three rows give every pair of the window once, and keep copies, nulls and not-a-number values as the plain join does."""
    import numpy as np

    from lumenspec.operators.matching import band_join, band_pairs

    r = np.random.default_rng(3)
    some = [float(v) for v in r.choice([0.0, 1.0, 2.5, *(6 * r.random(60) - 2)], 150)] + [None, float("nan")]
    a = spark.createDataFrame([(i, v) for i, v in enumerate(some[:60] + some[-2:])], "i long, x double")
    b = spark.createDataFrame([(i % 140, v) for i, v in enumerate(some)], "j long, y double")
    key = lambda df: sorted(tuple(x) for x in df.select("i", "x", "j", "y").collect())
    want = sorted((i, x, j, y) for i, x in a.collect() for j, y in b.collect() if x is not None and y is not None and abs(x - y) <= 0.75)
    assert want and key(band_pairs(a, b, "x", "y", 0.75, 3)) == want == key(band_join(a, b, "x", "y", 0.75))


def test_mass_window_join_writes_few_bytes_a_pair(spark, tmp_path):
    """30 copies of 500 masses, in any order: half a byte a pair at most on disk, since a library row's pairs lie together in order of mass."""
    import numpy as np

    price = np.random.default_rng(4).integers(0, 5_000_000, 500) / 100
    rows = [(k * 1000 + i, float(p), "1-URGENT") for k in range(30) for i, p in enumerate(price)]
    rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    __spark_entry__.queries()["mass_window_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    mass = price / 1000
    pairs = 30 * 30 * int((np.abs(mass[None, ::50] - mass[np.arange(500) % 50 != 0][:, None]) <= 1).sum())
    assert spark.read.parquet(f"{tmp_path}/out").count() == pairs
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * pairs


def test_equal_spectra_are_searched_once(spark, monkeypatch):
    """Twelve copies of a library and of analytes: each spectrum that differs is one row of what the blocks get, and the best are those of the plain search."""
    import numpy as np

    from lumenspec.operators import search
    from lumenspec.operators.matching import match_bins

    r = np.random.default_rng(8)
    one = [(int(i), int(m), float(r.integers(1, 4))) for i in range(40) for m in np.unique(r.integers(1, 12, 3))]
    rows = spark.createDataFrame([(i + 100 * c, m, x) for c in range(12) for i, m, x in one], "spec_id long, mz int, intensity double")
    a, b = rows.where("spec_id % 100 < 10"), rows.where("spec_id % 100 >= 10")
    sizes, write = [], search.written
    monkeypatch.setattr(search, "written", lambda df: (sizes.append((out := write(df)).count()), out)[1])
    key = lambda df: sorted((x["analyte"], x["rank"], x["lib"], x["score"]) for x in df.collect())
    monkeypatch.setattr(search, "PART", 20)
    monkeypatch.setattr(search, "MEETINGS", 30)
    got = key(search.search_all(a, b, k=25, top_n=0, shared_only=True))
    assert max(sizes[1:]) <= 30 and got == key(match_bins(a, b, 25))


def test_block_search_keeps_the_best(spark):
    """Slices and parts against all pairs: sixth digits on a tie, fingerprints without a shared m/z, scores of 0, repeated m/z."""
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np
    import pyarrow as pa

    from lumenspec.operators import search

    assert search._millionths(np.array([0.0078125, 0.1234565, 0.12345649999999997, 0.5, 0.0])).tolist() == [7813, 123457, 123456, 500000, 0]
    r = np.random.default_rng(2)

    def spectra(n, first):
        mz = [np.sort(r.integers(0, 9, r.integers(1, 6))).astype(float) for _ in range(n)]
        sets = [sorted({int(x) for x in r.integers(0, 90, 6)}) if r.random() < 0.3 else None for _ in range(n)]
        kinds = {"id": pa.int64(), "mz": pa.list_(pa.float64()), "intensity": pa.list_(pa.float64()), "set": pa.list_(pa.int32())}
        rows = {"id": np.arange(first, first + n), "mz": mz, "intensity": [r.integers(0, 4, len(m)).astype(float) for m in mz], "set": sets}
        return pa.table({k: pa.array(rows[k], t) for k, t in kinds.items()})

    def plain(a, b, top_n, shared_only):
        tops = lambda m, i: [m[j] for j in sorted(range(len(m)), key=lambda j: (-i[j], m[j]))[:top_n]]
        norm = sum(m * i for m, i in zip(*a[:2])) * sum(m * i for m, i in zip(*b[:2]))
        met = [(x * i, y * j) for x, i in zip(*a[:2]) for y, j in zip(*b[:2]) if x == y]
        score = sum(np.sqrt(p) * np.sqrt(q) for p, q in met) ** 2 / norm if norm else 0.0
        if top_n:
            p, q = tops(*a[:2]), tops(*b[:2])
            both = sum(x == y for x in p for y in q)
            score = np.sqrt(score * both / max(len(p) + len(q) - both, 1))
        if a[2] is not None and b[2] is not None and (either := len(set(a[2]) | set(b[2]))):
            score = 0.7 * score + 0.3 * len(set(a[2]) & set(b[2])) / either
        return None if shared_only and not met else int(Decimal(repr(float(score))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6))

    a, b = spectra(40, 0), spectra(300, 1000)
    sides = [[tuple(t[c][i].as_py() for c in ("mz", "intensity", "set")) for i in range(t.num_rows)] for t in (a, b)]
    for top_n, shared_only, part, meetings in ((0, True, 1 << 17, 1 << 16), (0, True, 40, 50), (3, False, 60, 40), (10, False, 1 << 17, 10), (0, False, 30, 1 << 16)):
        search.PART, old = part, (search.PART, search.MEETINGS)
        search.MEETINGS = meetings
        try:
            kept = search.best_of_block(a, b, 12, top_n, shared_only)
        finally:
            search.PART, search.MEETINGS = old
        for i, row in enumerate(kept):
            want = sorted((-s, j) for j, y in enumerate(sides[1]) if (s := plain(sides[0][i], y, top_n, shared_only)) is not None)[:12]
            row = row[row != np.iinfo(np.int64).max]
            got = [((x >> search.PLACE_BITS) - ((1 << search.CUT_BITS) - 1), x & ((1 << search.PLACE_BITS) - 1)) for x in row.tolist()]
            assert [p for _, p in got] == [p for _, p in want] or all(abs(x[0] - y[0]) <= 1 for x, y in zip(got, want)) and len(got) == len(want), (i, top_n)


def test_band_pairs_lie_in_runs(spark, tmp_path):
    """Twenty copies of 60 masses: a row of the left side stands once beside all rows of one mass, so files hold it once a run, and so the difference."""
    import numpy as np
    import pyarrow.parquet as pq

    from lumenspec.operators.matching import band_pairs

    mass = [float(x) for x in 10 * np.random.default_rng(6).random(60)]
    rows = spark.createDataFrame([(c * 60 + i, m) for c in range(20) for i, m in enumerate(mass)], "id int, m double")
    a, b = rows.where("id % 5 = 0").selectExpr("id as i", "m as x"), rows.where("id % 5 <> 0").selectExpr("id as j", "m as y")
    band_pairs(a, b, "x", "y", 1.0).selectExpr("i", "j", "abs(x - y) as d", "y").write.parquet(f"{tmp_path}/out")
    runs, seen = 0, 0
    for f in (tmp_path / "out").glob("*.parquet"):
        t = pq.read_table(f).to_pydict()
        seen += len(t["i"])
        runs += sum(k == 0 or (t["i"][k], t["y"][k]) != (t["i"][k - 1], t["y"][k - 1]) for k in range(len(t["i"])))
    want = [(i, j) for i in range(60) for j in range(60) if i % 5 == 0 and j % 5 and abs(mass[i] - mass[j]) <= 1]
    assert want and seen == 400 * len(want) and runs == 20 * len(want)
