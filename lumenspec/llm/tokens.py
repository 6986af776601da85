"""Token ids of whole texts, and their materialisation in training order.

`encode` cuts texts where the tokenizer's pattern always cuts (before a single space, around a single newline, between
letters and marks), hashes the pieces, and gives each distinct piece to the tokenizer once; the ids of a text are gathered from those of its pieces.

`materialise` assigns each fixed-length sequence the slot that a keyed Feistel permutation gives its running number,
deals the sequences to partitions by ranges of shards, and writes every shard as one file of fixed-stride rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_table, chunks, run_dir, span_hashes, text_buffers

END = 1
_caches: dict[str, Cache] = {}
_encoders: dict[str, object] = {}
CACHED, SEGMENTS = 200_000, 8  # pieces in each half of a worker's cache; tables that the young half keeps apart
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False  # an apostrophe may belong to the letters after it


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's ranks (the same ids as the .json of that name)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def piece_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that can be encoded alone: texts' starts, single spaces and single newlines between non-spaces,
    and changes between ASCII letters and marks (but apostrophes).

    Where a neighbour may belong to a space beyond ASCII there is no cut; pieces are then longer, never wrong.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n >= 3:
        letter, mark = _LETTER[data], _MARK[data]
        edge[1:-1] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        space = SPACE[data]
        maybe = (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        left = ~space  # this byte surely ends a character that is no space
        left[1:] &= ~(((data[1:] == 0x85) | (data[1:] == 0xA0)) & (data[:-1] == 0xC2))
        left[2:] &= ~maybe[:-2]
        right = ~space & ~maybe & (data != 0xC2)
        single = np.zeros(n, bool)
        single[1:-1] = left[:-2] & right[2:]
        edge[:-1] |= single & (data == 32)
        line = single & (data == 10)
        edge[:-1] |= line
        edge[1:] |= line
    return np.flatnonzero(edge[:-1])


def _running(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of spans, one after another."""
    before = _running(size)
    return np.repeat(begin - before[:-1], size) + np.arange(before[-1])


class Cache:
    """Ids of pieces by their hash, as sorted tables (keys, begin, size, ids). When the young half has CACHED pieces, it
    becomes the old half; what is found there moves to the young half again, so frequent pieces stay."""

    def __init__(self) -> None:
        self.young: list[tuple] = []
        self.old: list[tuple] = []

    def find(self, hashes: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """[(places in hashes, sizes, ids)] of what is known, and the places of the rest."""
        todo, found = np.arange(len(hashes)), []
        for young, tables in ((True, self.young), (False, self.old)):
            for keys, begin, size, ids in tables:
                at = np.minimum(np.searchsorted(keys, hashes[todo]), len(keys) - 1)
                hit = keys[at] == hashes[todo]
                if hit.any():
                    place, at = todo[hit], at[hit]
                    found.append((place, size[at], ids[_spans(begin[at], size[at])]))
                    if not young:
                        self.add(hashes[place], *found[-1][1:])
                    todo = todo[~hit]
        return found, todo

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.young.append((hashes[order], _running(size)[:-1][order], size[order], ids))
        if len(self.young) > SEGMENTS:
            keys, begin, size, ids = zip(*self.young)
            shift = _running(np.array([len(x) for x in ids]))
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            self.young = [(keys[order], np.concatenate([x + s for x, s in zip(begin, shift)])[order], np.concatenate(size)[order], np.concatenate(ids))]
            if len(keys) > CACHED:
                self.young, self.old = [], self.young


def _encode_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids, the ids) of pieces in turn. A piece without spaces, but perhaps one in front, stays one between newlines: those go in one call."""
    odd = SPACE[data] | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3)  # perhaps a space beyond ASCII
    odds = _running(odd)
    plain = (odds[ends] == odds[starts + 1]) & (~odd[starts] | (data[starts] == 32) & (ends - starts > 1))
    size, ids = np.zeros(len(starts), np.int64), [None] * 2
    line = ranks.encode_ordinary("\n")[0]
    s, n = starts[plain], (ends - starts)[plain]
    text = np.full(n.sum() + len(n), 10, np.uint8)
    text[_spans(_running(n + 1)[:-1], n)] = data[_spans(s, n)]
    got = np.array(ranks.encode_to_numpy(text.tobytes().decode("utf-8", "replace"), disallowed_special=()), np.uint32)
    size[plain] = np.diff(np.concatenate([[-1], np.flatnonzero(got == line)])) - 1
    raw = data.tobytes()
    rest = [ranks.encode_ordinary(raw[x:y].decode("utf-8", "replace")) for x, y in zip(starts[~plain].tolist(), ends[~plain].tolist())]
    size[~plain] = [len(x) for x in rest]
    ids = np.zeros(size.sum(), np.uint32)
    begin = _running(size)[:-1]
    ids[_spans(begin[plain], size[plain])] = got[got != line]
    ids[_spans(begin[~plain], size[~plain])] = np.array([y for x in rest for y in x], np.uint32)
    return size, ids


def _known_pieces(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of rows [a, b): of the chunk's distinct pieces where their ids begin, how many they are, and the ids; for each piece in turn which it is; the texts' edges among the pieces."""
    data, offsets = text_buffers(column)
    cache = _caches.setdefault(path, Cache())
    for a, b in chunks(offsets, 1 << 20):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        starts = piece_edges(part, at)
        ends = np.append(starts[1:], len(part)).astype(np.int64) if len(starts) else starts
        back, hashes = pd.factorize(span_hashes(part, starts, ends))
        found, unseen = cache.find(hashes)
        if len(unseen):
            first = np.zeros(len(hashes), np.int64)
            first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
            size, ids = _encode_pieces(part, starts[first[unseen]], ends[first[unseen]], encoder(path))
            cache.add(hashes[unseen], size, ids)
            found.append((unseen, size, ids))
        begin, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        if found:
            place, sizes, ids = map(np.concatenate, zip(*found))
            begin[place], size[place] = _running(sizes)[:-1], sizes
        else:
            ids = np.zeros(0, np.uint32)
        yield a, b, begin, size, ids, back, np.searchsorted(starts, at)


def encode(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids as uint32) of whole texts; null and empty texts have no ids. Special tokens' strings are ordinary text."""
    for a, b, begin, size, ids, back, edge in _known_pieces(column, path):
        count = size[back]
        ids, edge = ids[_spans(begin[back], count)], _running(count)[edge]
        for i in range(b - a):
            yield a + i, ids[edge[i] : edge[i + 1]]


def count_ids(column: pa.Array, path: str) -> np.ndarray:
    """How many ids each whole text has."""
    out = np.zeros(len(column), np.int64)
    for a, b, _, size, _, back, edge in _known_pieces(column, path):
        out[a:b] = np.diff(_running(size[back])[edge])
    return out


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network over the next even power of two, walking each value on until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            f = right + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD6E8FEB86659FD93) % (1 << 64))
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences_of(ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces; its ids end with the id 1."""
    ids = np.append(ids, np.uint32(END))
    for s in range(0, len(ids), length):
        yield s, ids[s : s + length]


def _rows_seen(batch: pa.RecordBatch, ids: int, texts: int) -> tuple[int, int]:
    """The running checksums of a partition's (doc_id, text) after one more batch."""
    data, offsets = text_buffers(batch.column(1))
    sizes = np.concatenate([batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)[:, None], np.diff(offsets)[:, None]], 1)
    return zlib.crc32(sizes.astype("<i8").tobytes(), ids), zlib.crc32(data[offsets[0] : offsets[-1]], texts)


def materialise(df: DataFrame, out: str, path: str, length: int = 256, rows_per_shard: int = 16384, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text", tasks: int = 100_000) -> DataFrame:
    """Write the sequences of all texts as shards of fixed-stride rows under the URI `out`, in a keyed random order.

    Each document's ids and a closing id 1 are cut into sequences of `length`; the last is padded with id 0. Rows are
    little-endian unsigned 16-bit ids (32-bit if the vocabulary is larger), so slot s is row s % rows_per_shard of file
    s // rows_per_shard, and reading can resume at any slot. Returns a written table of doc_id, start, length, slot,
    shard, ids_crc32 (of the unpadded ids as stored). A shard is written, then moved to its name, by the task that gives
    its rows, so a task that runs again writes the same bytes; at most `tasks` tasks take ranges of whole shards. The
    manifest comes last, and what attempts that failed have left is deleted before, so that a folder with one is
    complete and holds nothing else. A folder that holds anything is refused: it may have another run's manifest.

    `df` is a scan or written table: it is read twice (to number the sequences, then to write them), and both reads must
    deal the same rows to the same partitions, which checksums of ids and texts verify. Null texts have the closing id
    only; a null id stays null; repeated rows have sequences of their own; an empty table writes a manifest and no
    shard; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dtype = np.dtype("<u2") if encoder(path).n_vocab <= 1 << 16 else np.dtype("<u4")
    stride = length * dtype.itemsize

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = ids = texts = 0
        for b in batches:
            n += int((-(-(count_ids(b.column(1), path) + 1) // length)).sum())
            ids, texts = _rows_seen(b, ids, texts)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n, ids, texts)], ["part", "n", "ids", "texts"])

    seen = {p: x for p, *x in docs.mapInArrow(count, "part long, n long, ids long, texts long").collect()}
    total, first = 0, {}
    for p in sorted(seen):
        first[p], total = total, total + seen[p][0]
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    if fs.get_file_info(pafs.FileSelector(root)):
        raise FileExistsError(f"{out} is not empty")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n = sum_ids = texts = 0
        for b in batches:
            sum_ids, texts = _rows_seen(b, sum_ids, texts)
            names = b.column(0).to_pylist()
            rows: list[tuple] = []
            for i, ids in encode(b.column(1), path):
                rows += [(names[i], s, len(x), x.astype(dtype).tobytes()) for s, x in sequences_of(ids, length)]
                if len(rows) >= 4096 or i == len(names) - 1:
                    slot = feistel(np.arange(n, n + len(rows)) + first.get(part, 0), total, key)
                    n += len(rows)
                    d, s, m, x = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(slot), pa.array(slot // rows_per_shard), pa.array(x, pa.binary())], ["doc_id", "start", "length", "slot", "shard", "ids"])
                    rows = []
        if [n, sum_ids, texts] != seen.get(part, [0, 0, 0]):
            raise RuntimeError(f"partition {part} had other rows when it was read again")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        now, stream, name = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(name, f"{root}/shard-{now:08d}.bin")

        for b in batches:
            shards, ids = b.column(4).to_numpy(), b.column(5)
            crc = []
            for i, k in enumerate(shards.tolist()):
                if k != now:
                    close()
                    now, name = k, f"{root}/.writing-{k:08d}-{TaskContext.get().taskAttemptId()}"
                    stream = fs.open_output_stream(name)
                x = ids[i].as_py()
                crc.append(zlib.crc32(x))
                stream.write(x.ljust(stride, b"\0"))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(crc, pa.int64())], ["doc_id", "start", "length", "slot", "shard", "ids_crc32"])
        close()

    shards = max(1, -(-total // rows_per_shard))
    parts = min(shards, tasks)
    rows = docs.mapInArrow(sequences, "doc_id long, start long, length long, slot long, shard long, ids binary")
    dealt = rows.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("slot")
    index = as_table(dealt.mapInArrow(write, "doc_id long, start long, length long, slot long, shard long, ids_crc32 long"))
    for file in fs.get_file_info(pafs.FileSelector(root)):
        if file.base_name.startswith(".writing-"):
            fs.delete_file(file.path)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "shards": -(-total // rows_per_shard), "length": length, "dtype": dtype.str, "rows_per_shard": rows_per_shard, "key": key, "rounds": 4}).encode())
    return index


def read_slots(out: str, first: int, n: int) -> np.ndarray:
    """n rows of ids from slot `first` on, read in sequence from the shards."""
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    n, got = max(0, min(n, m["sequences"] - first)), []
    dtype = np.dtype(m["dtype"])
    stride = m["length"] * dtype.itemsize
    while n:
        shard, row = divmod(first, m["rows_per_shard"])
        k = min(n, m["rows_per_shard"] - row)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(row * stride)
            got.append(np.frombuffer(f.read(k * stride), dtype).reshape(k, m["length"]))
        first, n = first + k, n - k
    return np.concatenate(got) if got else np.zeros((0, m["length"]), dtype)


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return materialise(docs, f"{run_dir(spark)}/tokens-{uuid.uuid4().hex}", vocabulary())
