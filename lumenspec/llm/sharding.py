"""Sharding by histogram sort: probe keys, count exact bytes below them, narrow, and exchange once.

Splitters start as the whole 64-bit key range. Each round counts bytes and rows between all probes in one pass over
(key, size), then narrows every splitter to the two probes around its share, until a probe is within tolerance or the
range holds at most one row. The driver holds probes and sums only, never keys of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, with_columns

LEAST, MOST = -(1 << 63), (1 << 63) - 1
OUT = ("shard", "slot")
BUCKETS = 1 << 16


def spread_key(group: Column, row: Column) -> Column:
    """64-bit key: 32 bits of the group's hash above 32 bits of the row's, so equal groups lie together and a hot one can still be split."""
    return F.shiftleft(F.xxhash64(group), 32).bitwiseOR(F.xxhash64(row).bitwiseAND(F.lit(0xFFFFFFFF)))


def _counts(keyed: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows with a key below each probe (probes ascending)."""
    at = np.array(probes, np.int64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for b in batches:
            where = np.searchsorted(at, b.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(size, where, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(where, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(size[some]), pa.array(rows[some])], ["i", "size", "rows"])

    sums = keyed.select("key", "size").mapInArrow(part, "i int, size long, rows long").groupBy("i").agg(F.sum("size"), F.sum("rows"))
    size, rows = [0] * (len(at) + 1), [0] * (len(at) + 1)
    for i, s, r in sums.collect():
        size[i], rows[i] = int(s), int(r)
    return np.cumsum(size).tolist()[:-1], np.cumsum(rows).tolist()[:-1]


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 32) -> list[int]:
    """shards - 1 keys; rows below the k-th hold (k + 1) / shards of all bytes, to within tolerance of a shard, or as near as one key allows."""
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    total = int(total)
    goal = np.array([total * (k + 1) / shards for k in range(shards - 1)])
    low, high = (np.tile(np.array([[key], [size], [rows]], object), (1, len(goal))) for key, size, rows in ((LEAST, 0, 0), (MOST, total, int(n))))  # key, bytes below, rows below
    slack = tolerance * total / shards
    while True:
        near = np.minimum(goal - low[1].astype(float), high[1].astype(float) - goal) <= slack
        wide = np.flatnonzero(~near & (high[2] - low[2] > 1).astype(bool) & (high[0] - low[0] > 1).astype(bool))
        if not len(wide):
            break
        ranges = {(low[0, k], high[0, k]) for k in wide}  # many goals may still share one
        tried = sorted({x for a, b in ranges for j in range(1, probes + 1) if a < (x := a + (b - a) * j // (probes + 1)) < b})
        below = np.array([tried, *_counts(keyed, tried)], object)
        at = np.searchsorted(below[1].astype(float), goal[wide], "right")  # probes with at most the goal's bytes below them
        left, right = at > 0, at < len(tried)
        for side, some, j, better in ((low, left, at - 1, np.greater), (high, right, at, np.less)):
            k, new = wide[some], below[:, j[some]]
            nearer = better(new[0], side[0, k]).astype(bool)
            side[:, k[nearer]] = new[:, nearer]
    pick = goal - low[1].astype(float) <= high[1].astype(float) - goal
    return np.maximum.accumulate(np.where(pick, low[0], high[0])).tolist() if len(goal) else []


def shard(df: DataFrame, key: Column, size: Column, order: list[str], shards: int = 24, tolerance: float = 0.002, bucket_bytes: int = 32 << 20) -> DataFrame:
    """The rows of `df` with shard (0 to shards - 1) and slot (gapless from 0 in each shard, in key order).

    A null key sorts as the least key, a null in `order` first, and a null size counts 0; rows of one key stay together, so rows that are repeated
    whole cannot be parted and a shard may be larger by them; an empty table gives an empty table; columns of `df` named
    shard or slot give way, others keep their names. Shards are cut into buckets of about bucket_bytes (BUCKETS in all at
    most) by the same histogram, so that one exchange deals the rows to many tasks and a hot text's rows to several; a
    slot is its bucket's first slot, known from the last histogram, plus the row's place in the bucket.
    """
    keep = [c for c in df.columns if c not in OUT]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = df.select(F.coalesce(key, F.lit(LEAST)).cast("long").alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), row)
    keyed = as_table(rows.select("key", "size"))
    cut = splitters(keyed, shards, tolerance)
    total = int(keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    buckets = min(BUCKETS, -(-total // bucket_bytes))
    bounds = sorted({*cut, *(splitters(keyed, buckets, 0.25, 4) if buckets > shards else ())} - {LEAST})
    below = _counts(keyed, bounds)[1] if bounds else []
    shard_of = np.searchsorted(np.array(cut, np.int64), np.array([LEAST, *bounds], np.int64), "right")
    first_row = np.array([0, *below], np.int64)
    opening = first_row[np.searchsorted(shard_of, shard_of, "left")]
    tables = np.array(bounds, np.int64), shard_of.astype(np.int32), first_row - opening

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, start = tables
        for b in batches:
            bucket = np.searchsorted(at, b.column(0).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bucket, pa.int64()), pa.array(of[bucket]), pa.array(start[bucket])], ["key", "row", "bucket", "shard", "start"])

    dealt = rows.mapInArrow(deal, with_columns(rows.select("key", "row").schema, "bucket long, shard int, start long"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", *[F.col(f"row.`{c}`") for c in order]))
    return dealt.select("row", "shard", (F.col("start") + place - 1).alias("slot")).select("row.*", "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents without an id are rows like others: of equal texts they come first. Edge rows otherwise: see shard."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), spread_key(text, F.col("doc_id")).alias("key"))
    out = shard(as_table(docs), F.col("key"), F.col("size"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
