"""Each catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lumenspec.plans import catalog, structures, studies

QUERIES, ORACLES = catalog.QUERIES | studies.QUERIES | structures.QUERIES, catalog.ORACLES | studies.ORACLES | structures.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    assert ours
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        theirs = rows(rel.columns, rel.fetchall())
        assert sorted(df.columns) == sorted(rel.columns) and len(ours) == len(theirs)
        for a, b in zip(ours, theirs):
            assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def test_dense_keeps_high_masses(spark, duck, tmp_path):
    rows = [(1, 1, 199, 5.0), (1, 2, 250, 7.0), (1, 3, 499, 9.0), (1, 4, 250, 8.0), (2, 1, 450, 3.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["spec_id"], r["mz"]): r["intensity"] for r in QUERIES["dense_sparse_roundtrip"](spark, str(tmp_path)).collect()}
    want = {(1, 199): 5 / 9, (1, 250): 8 / 9, (1, 499): 1.0, (2, 450): 1.0}
    assert got == pytest.approx(want, abs=2e-6)
