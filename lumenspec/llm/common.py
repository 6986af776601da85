"""What the operators of this subpackage share: durable tables, words, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}
EDGES = 1 << 16  # edges that one task holds while it contracts them
CHUNK = 1 << 19  # bytes of texts that are hashed at a time


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lumenspec-")
    return _own_dirs[app]


def run_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared one."""
    return f"{shared_dir(spark)}/lumenspec/{spark.sparkContext.applicationId}"


def as_table(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later plans start there and survive lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what as_table has written in this application, when no result that is still to be read starts there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_columns(schema: StructType, more: str) -> StructType:
    """The schema with more columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum: equal bytes, equal hash."""
    n = len(data)
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    total = np.zeros(n + 1, np.uint64)
    np.add(data, np.uint64(1), out=total[1:])
    total[1:] *= _powers[0][:n]
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+ of texts that lie one after another in `data`."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its sorted distinct hashes of `width` lower-cased words; fewer words hash as one sequence; no words: empty."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, row = word_spans(part, at)
        words = span_hashes(part, starts, ends)
        n = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for i in range(b - a):
            if n[i] >= width:
                yield a + i, np.unique(rolled[first[i] : first[i + 1] - width + 1])
            elif n[i]:
                h = np.full(1, n[i], np.uint64)
                for w in words[first[i] : first[i + 1]]:
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
                yield a + i, h
            else:
                yield a + i, np.zeros(0, np.uint64)


def contracted(block: int):
    """For mapInArrow: of each `block` edges (u, v) of a task the stars around the smallest node of what they connect."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        seen = 0

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root[y]
            return x

        def flush() -> pa.RecordBatch:
            rows = [(x, top) for x in list(root) if (top := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                seen += 1
                if seen % block == 0:
                    yield flush()
        yield flush()

    return stars


def components(edges: DataFrame, rounds: int = 60, block: int = EDGES) -> DataFrame:
    """(node, label) for every node of the edges (u, v): label is the smallest node reachable.

    Tasks first contract `block` edges at a time; up to `block` edges in all are settled by that. For more, large-star and
    small-star steps follow in turn, each round written to the shared folder; a star forest is the fixed point.
    """
    edges = as_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = None
    for _ in range(rounds):
        n = edges.count()
        edges = as_table(edges.coalesce(max(1, -(-n // block))).mapInArrow(contracted(block), "u long, v long"))
        if n <= block:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = as_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
