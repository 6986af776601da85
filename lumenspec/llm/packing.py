"""Packing token pieces into windows by minimum bin slack over the multiset of lengths.

Documents are cut into full windows and one rest each. Only the histogram of lengths reaches the driver (at most as many
rows as a window has tokens). There, windows are filled one kind at a time: the longest length left opens the window, a
bitset subset-sum over the remaining multiset finds the sum closest to what is left, backtracking gives how often each
length is used, and the same kind is repeated as long as the counts last. The pieces then find their window by their
rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, with_columns
from .tokens import END, encode, vocabulary

RANKED = 512  # pieces of one length that a task ranks; more where a table would have over PARTS such tasks
PARTS = 1 << 16


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within `counts` whose sum is closest to `room` from below: {length: times}."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces of it in each window)]) for all pieces; lengths are 1 to capacity."""
    counts, out = {x: n for x, n in histogram.items() if n}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def pieces(df: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and a closing id 1, in full windows and one rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rows = b.column(0).to_pylist(), []
            for i, ids in encode(b.column(1), path):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                rows += [(names[i], s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity]), len(ids)) for s in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows with a column length (1 to capacity), doc_id and start -> with sequence_id and offset.

    `rows` is a written table. Pieces are ranked within their length in hash-dealt parts, as many as the histogram says,
    so one frequent length is no single task; ranks of a part follow those of the parts before it. What is broadcast has
    at most capacity + PARTS rows.
    """
    histogram = {int(x): int(n) for x, n in rows.groupBy("length").count().collect()}
    table, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, used in windows(histogram, capacity):
        offset = 0
        for length, n in used:
            table.append((length, taken[length], sequence, n, offset))
            taken[length] += times * n
            offset += length * n
        sequence += times
    plan = np.array(sorted(table), np.int64).reshape(-1, 5)
    starts = (plan[:, 0] << 44) + plan[:, 1]

    share = max(RANKED, -(-sum(histogram.values()) // PARTS))
    parts = rows.sparkSession.createDataFrame([(x, -(-n // share)) for x, n in histogram.items()], "_length long, _parts long")
    dealt = rows.join(F.broadcast(parts), F.col("length") == F.col("_length")).select(*rows.columns, F.pmod(F.xxhash64("doc_id", "start"), F.col("_parts")).alias("_part"))
    sizes = dealt.groupBy(F.col("length").alias("_length"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_p")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start")) - 1
    ranked = dealt.withColumn("_place", place.cast("long")).join(F.broadcast(sizes), (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select(*rows.columns, (F.shiftleft(F.col("length"), 44) + F.col("_before") + F.col("_place")).alias("_key"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(starts, key, "right") - 1]
            nth = key - (row[:, 0] << 44) - row[:, 1]
            arrays = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * row[:, 0])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(find, with_columns(rows.schema, "sequence_id long, offset long"))


def pack(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has its closing id only; a null id stays null; repeated rows are packed each; an empty table
    gives an empty table; other columns are ignored.
    """
    return assign(as_table(pieces(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path, capacity)), capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
