"""The manifest against a tree that is built plainly, and against single changes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumenspec.llm import merkle

TEXTS = [None, "", " ", "a", "Grüße 漢字 😀", "x" * 200_000] + [f"text {i}" for i in range(40)]
DOCS = [(None if i % 9 == 4 else i, t, [None, "de", "en", "é", "", "one"][0 if i % 11 == 0 else 1 if i < 30 else i % 5], None if i % 3 else "s", None if i % 4 == 1 else i, 7) for i, t in enumerate(TEXTS)]
DOCS += DOCS[2:6] + [(500, "only", "single", "s", 4, 7)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    doc_id, text, lang, source, n_chars = r[:5]
    n_chars = None if n_chars is None else n_chars + more
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grown(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([H(*tree[-1][i : i + 2]) for i in range(0, len(tree[-1]), 2)])
    return tree


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: grown([leaf(r) for r in by[g]]) for g in langs}
    top = grown([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(by[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = leaf(r, int(hit)), []
            for tree, i in ((trees[g], at), (top, k)):
                for nodes in tree[:-1]:
                    other = nodes[i ^ 1 : (i ^ 1) + 1]
                    proof += other
                    node = H(*(other + [node] if i & 1 else [node] + other))
                    i >>= 1
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _leaf int"


@pytest.mark.parametrize("n", [0, 1, 2, len(DOCS)])
def test_documents(spark, tmp_path, n):
    rows = DOCS[-n:] if n else []
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_many_blocks(spark):
    """Blocks of two leaves, groups of one block and of many: any one change is found, and its proof leads to another root."""
    rows = [(i, f"t{i}", "big" if i % 9 else f"g{i % 4}", "s", i) for i in range(70)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).withColumn("proof", F.lit(1)).withColumn("root", F.lit(2))
    whole = merkle.document_leaf(F.col("n_chars"))
    found = F.when(F.col("doc_id") % 10 == 3, merkle.document_leaf(F.col("n_chars") + 1))
    out = merkle.manifest(df, whole, "lang", "doc_id", found, least_bits=1).collect()
    want = {r[0]: r for r in brute(rows)}
    assert len(out) == len(rows)
    for r in out:
        assert (r["leaf"], r["subroot"], r["root"]) == want[r["doc_id"]][1:4]
        assert H(*r["proof"]) == want[r["doc_id"]][4] and len(r["proof"]) == len(r["path"].replace("-", ""))
        node, proof = r["leaf"], iter(r["proof"])
        for side in r["path"]:
            node = H(next(proof), node) if side == "L" else H(node, next(proof)) if side == "R" else H(node)
        assert node == r["root"] and (r["folded_root"] == r["root"]) == (r["doc_id"] % 10 != 3)


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "GROUPS", 3)
    df = spark.createDataFrame([(i, "t", f"g{i}", "s", i, 1) for i in range(4)], SCHEMA)
    with pytest.raises(ValueError, match="groups"):
        merkle.manifest(df, merkle.document_leaf(F.col("n_chars")), "lang", "doc_id")
