"""Merkle dataset manifest: a hash tree over each group's rows, a tree over the groups, a proof and a fold for every row.

Digests of rows are sorted by one range exchange; a row's place in its group is its place in its sorted partition plus
the rows of the group in the partitions before. Blocks of 2^k consecutive leaves are reduced by executors, one row a
block. The driver gets a block's root alone, builds the small top of the tree and broadcasts, for each block, the
siblings on the way from it to the root. Executors then finish the proofs inside the blocks and fold every row anew.
k grows with the table, so that the driver never holds more than BLOCKS roots and one a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

BLOCKS = 1 << 14  # roots of blocks that the driver builds the top from
LEAST_BITS = 6  # a block has 64 leaves at least
GROUPS = 1 << 16
SLICE = 2048  # rows of a block that leave a task at a time
SIDES = {"L": 0, "R": 1, "-": 2}


def digest(*parts: bytes) -> bytes:
    """The SHA-256 of the parts one after another, as hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """All levels from these nodes up: until one is left, or exactly `most` steps. A last node without a pair is hashed alone."""
    out = [nodes]
    while (len(out[-1]) > 1) if most is None else (len(out) <= most):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def way(tree: list[list[bytes]], at: int) -> list[tuple[str, bytes]]:
    """For each step from node `at` to the top of the tree: the sibling's side (L, R, or - for none) and digest."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append(("L" if at & 1 else "R", nodes[other]) if other < len(nodes) else ("-", b""))
        at >>= 1
    return out


def folded(node: bytes, steps: list[tuple[str, bytes]]) -> bytes:
    """The root that a node gives with these siblings."""
    for side, other in steps:
        node = digest(other, node) if side == "L" else digest(node, other)
    return node


def top_of(roots: list[tuple[object, int, bytes]]) -> tuple[bytes, dict]:
    """Of block roots (group, block, root): the root of all, and for each (group, block) its group's root and its way up."""
    groups: dict = {}
    for group, block, root in sorted(roots, key=lambda r: (r[0] is not None, str(r[0]).encode() if r[0] is not None else b"", r[1])):
        groups.setdefault(group, []).append(root)
    trees = {g: levels(nodes) for g, nodes in groups.items()}
    upper = levels([t[-1][0] for t in trees.values()])
    ways = {}
    for k, (g, tree) in enumerate(trees.items()):
        above = way(upper, k)
        for b in range(len(groups[g])):
            ways[g, b] = tree[-1][0], way(tree, b) + above
    return upper[-1][0], ways


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (_group, _order, _leaf, ...) with _at (place in the group, by order, then leaf) and _n (rows of the group).

    The order, the leaf and a row number make up the sort key, so neither a hot group nor repeated rows stay in one partition.
    """
    leaves = as_table(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    key = ["_group", "_order", "_leaf", "_tie"]
    ranged = as_table(leaves.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id()).drop("_tie"))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    parts = ranged.groupBy("_group", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    parts = as_table(parts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), offset.alias("_offset"), F.sum("_rows").over(Window.partitionBy("_group")).alias("_n")))
    met = ranged.join(parts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("_at", F.col("_id") + F.col("_offset")).drop("_id", "_offset", "_part", "_g", "_p")


def packed(leaves: DataFrame, bits: int) -> DataFrame:
    """One row a block of 2^bits leaves: group, block, its leaves in order, and its root (that of the group if it is the only one)."""
    order = leaves.schema["_order"].dataType.simpleString()

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        nodes = [x.hex().encode() for x in t["_leaf"].to_pylist()]
        tree = levels(nodes, bits if t["_n"][0].as_py() > 1 << bits else None)
        row = {c: [t[c].to_pylist()] for c in ("_order", "_leaf", "_found")}
        return pa.table({"_group": pa.array([key[0].as_py()], t["_group"].type), "_block": pa.array([key[1].as_py()], pa.int64()), "_n": pa.array([t["_n"][0].as_py()], pa.int64()), "_root": [tree[-1][0].decode()], "_order": pa.array(row["_order"], pa.list_(t["_order"].type)), "_leaf": pa.array(row["_leaf"], pa.list_(pa.binary())), "_found": pa.array(row["_found"], pa.list_(pa.binary()))})

    kind = leaves.schema["_group"].dataType.simpleString()
    schema = f"_group {kind}, _block long, _n long, _root string, _order array<{order}>, _leaf array<binary>, _found array<binary>"
    return leaves.withColumn("_block", F.shiftright("_at", bits)).groupBy("_group", "_block").applyInArrow(pack, schema)


def _texts(values: np.ndarray) -> pa.Array:
    """64-character digests (S64) as an Arrow string array."""
    data = np.ascontiguousarray(values)
    at = np.arange(len(data) + 1, dtype=np.int32) * 64
    return pa.StringArray.from_buffers(len(data), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes()))


def manifest(df: DataFrame, leaf: Column, group: str, order: str, found: Column | None = None, most_blocks: int = BLOCKS, least_bits: int = LEAST_BITS) -> DataFrame:
    """(group, order, leaf, subroot, root, proof, path, folded_root) for every row of `df`.

    `leaf` is a row's digest as hexadecimal text. In a group leaves ascend by order (nulls first, equal ones by digest);
    every two consecutive nodes become their digest's parent, a last one alone becomes its own, until one is left, the
    subroot; subroots by group (null first, then bytewise) give the root in the same way. `proof` lists a row's siblings
    from below, `path` has a letter a step: the sibling's side, L or R, or - for none. `folded_root` is what `found` (a
    digest of the row as it is found now; null or not given: unchanged) gives with the proof, so it is the root if and
    only if nothing changed. Null groups are a group of their own; repeated rows are leaves of their own; an empty table
    gives an empty table; other columns are ignored, whatever their names. More than GROUPS groups are an error: the
    driver holds one root a group.
    """
    binary = lambda c: F.unhex(c)
    rows = df.select(F.col(f"`{group}`").alias("_group"), F.col(f"`{order}`").alias("_order"), binary(leaf).alias("_leaf"), (binary(found) if found is not None else F.lit(None).cast("binary")).alias("_found"))
    leaves = placed(rows)
    n = leaves.count()
    bits = max(least_bits, math.ceil(math.log2(max(1, n) / most_blocks)))
    blocks = as_table(packed(leaves, bits))
    if blocks.select("_group").distinct().count() > GROUPS:
        raise ValueError(f"more than {GROUPS} groups: their roots are built on the driver")
    roots = [(r[0], r[1], r[2].encode()) for r in blocks.select("_group", "_block", "_root").collect()]
    root, ways = top_of(roots) if roots else (b"", {})
    shared = df.sparkSession.sparkContext.broadcast((root, ways))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ways = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                block = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_group", "_block", "_n", "_order", "_leaf", "_found")}
                group, number, size = (block[c][k].as_py() for c in ("_group", "_block", "_n"))
                subroot, above = ways[group, number]
                leaves, found = ([x and x.hex().encode() for x in block[c][k].values.to_pylist()] for c in ("_leaf", "_found"))
                tree = levels(leaves, bits if size > 1 << bits else None)
                known: dict[bytes, bytes] = {}  # what the steps above the block make of a digest
                order = block["_order"][k].values
                for a in range(0, len(leaves), SLICE):
                    yield from _finished(tree, above, known, group, order, leaves, found, a, min(a + SLICE, len(leaves)), subroot, root, batch.column(0).type)

    kinds = {c: leaves.schema[c].dataType.simpleString() for c in ("_group", "_order")}
    schema = f"`{group}` {kinds['_group']}, `{order}` {kinds['_order']}, leaf string, subroot string, root string, proof array<string>, path string, folded_root string"
    return blocks.mapInArrow(finish, schema)


def _finished(tree, above, known, group, order, leaves, found, a, b, subroot, root, kind) -> Iterator[pa.RecordBatch]:
    """The rows a to b of a block."""
    n, inside = b - a, len(tree) - 1
    steps = inside + len(above)
    sides, sibling = np.full((n, steps), SIDES["-"], np.int8), np.zeros((n, steps), "S64")
    at = np.arange(a, b)
    for level in range(inside):
        nodes, other = np.array(tree[level], "S64"), (at >> level) ^ 1
        some = other < len(nodes)
        sibling[some, level] = nodes[other[some]]
        sides[some, level] = np.where((at[some] >> level) & 1, SIDES["L"], SIDES["R"])
    for j, (side, node) in enumerate(above, inside):
        sides[:, j], sibling[:, j] = SIDES[side], node
    there = sides != SIDES["-"]
    proof = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]), pa.int32()), _texts(sibling[there]))
    letters = np.frombuffer(b"LR-", "S1")[sides]
    ends = []
    for i in range(n):
        node, where = found[a + i] or leaves[a + i], a + i
        for nodes in tree[:-1]:
            other = where ^ 1
            if other >= len(nodes):
                node = digest(node)
            elif where & 1:
                node = digest(nodes[other], node)
            else:
                node = digest(node, nodes[other])
            where >>= 1
        if node not in known:
            known[node] = folded(node, above)
        ends.append(known[node])
    same = lambda x: _texts(np.full(n, x, "S64"))
    out = [pa.array([group] * n, kind), order.slice(a, n), _texts(np.array(leaves[a:b], "S64")), same(subroot), same(root), proof, pa.array([letters[i].tobytes().decode() for i in range(n)], pa.string()), _texts(np.array(ends, "S64"))]
    yield pa.RecordBatch.from_arrays(out, ["g", "o", "leaf", "subroot", "root", "proof", "path", "folded_root"])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(n_chars: Column) -> Column:
    """The digest of a document with this n_chars: each field as its byte count, a colon and its value, or - if it is null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    values = [n_chars if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]).cast("binary"), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and how a tampered copy of it folds. A document without an id is not tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(hit & F.col("n_chars").isNotNull(), document_leaf(F.col("n_chars") + 1))
    out = manifest(docs, document_leaf(F.col("n_chars")), "lang", "doc_id", found)
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format("{n}" if c == "n_chars" else c) for c in FIELDS) + ")"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(n="(n_chars + 1)")} END AS found FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h FROM p
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, level AS height, h AS subroot FROM nodes QUALIFY row_number() OVER (PARTITION BY lang ORDER BY level DESC) = 1),
s AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM subroots),
upper AS (
  SELECT 0 AS level, pos, subroot AS h FROM s
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY level, pos // 2),
r AS (SELECT level AS height, h AS root FROM upper ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT p.lang, p.pos, l.level AS step, CASE WHEN n.h IS NULL THEN '-' WHEN (p.pos >> l.level) % 2 = 1 THEN 'L' || n.h ELSE 'R' || n.h END AS x
  FROM p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN range(64) l(level) ON l.level < s.height
       LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = l.level AND n.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, 64 + l.level, CASE WHEN n.h IS NULL THEN '-' WHEN (s.pos >> l.level) % 2 = 1 THEN 'L' || n.h ELSE 'R' || n.h END
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN r ON true JOIN range(64) l(level) ON l.level < r.height
       LEFT JOIN upper n ON n.level = l.level AND n.pos = xor(s.pos >> l.level, 1)),
w AS (SELECT lang, pos, list(x ORDER BY step) AS x FROM steps GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(w.x, []) AS x, list_reduce(list_prepend(coalesce(found, leaf), coalesce(w.x, [])), lambda a, b: sha256(CASE b[1] WHEN 'L' THEN b[2:] || a WHEN 'R' THEN a || b[2:] ELSE a END)) AS folded_root
      FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN r ON true LEFT JOIN w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(x, lambda y: y <> '-'), lambda y: y[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
