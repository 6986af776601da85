"""Exact n-gram Jaccard join of all documents with a token-group matrix.

A document is the set of its word shingles; documents with equal sets are one class. Classes link when their Jaccard
similarity reaches the threshold. The result is each document's component under those links.

1. A count sketch of all shingles gives a global order, rare first (any fixed order keeps prefix filtering exact; a
   good one keeps prefixes free of shared passages). Two sets that link share a shingle among the first
   n - ceil(t n) + 1 of each, at places early enough to leave room for the overlap they need. These prefix rows, with
   size and place, are the one large shuffle; frequent shingles are dealt to several tasks each.
2. Similar classes become groups of at most GROUP: a class goes to the group of the most frequent of its shared prefix
   shingles, among classes of like size.
3. Token-group matrix: a group's row holds the union of its members' shingles, each with a 64-bit mask of the members
   that have it. Members are compared within the group by the product of the masks.
4. Two groups are candidates when they share a prefix shingle that sizes and places allow, and enough of them. Each first
   meets one other (the star round), which settles groups of copies; then all candidate pairs whose members do not yet lie
   in one component. A member's overlap with the other group's union bounds its overlap with any member there; only rows
   that reach the threshold are opened, and these are compared by the product of the masks.
5. Components of all links found. A pair that links is in one group, or in a candidate pair of groups, or connected before.

Postings hold groups, not documents, so copies count once and a large cluster of m classes costs (m / GROUP)^2 pairs at
most, of which those inside one component are left out. SMALL changes the join's plan, never its result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, components, mix, shingle_sets, with_columns

SKETCH_BITS, SLICES = 20, 64
FREQUENT, GROUP = 1000, 64  # rows of a posting in one task; classes of a group (bits of a mask)
GROUP_SHINGLES = 1 << 18  # shingles of a group's members, about
SMALL = 100_000  # classes up to which their ids are broadcast to the scan of texts
PASS = 64  # sketches that one task adds up


def set_id(tokens: np.ndarray) -> int:
    """64 bits that identify a set of shingles."""
    return int((mix(mix(tokens) + np.uint64(0x51ED270B)).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).astype(np.int64)) if len(tokens) else 0


def at_least(n: np.ndarray | int, percent: int):
    """ceil(percent n / 100)."""
    return -(-n * percent // 100)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """From (doc_id, text) of all rows: kind 0: (id = doc_id, n, sig); kind 1: a slice (id) of the task's counts of shingles by hash."""
    span = (1 << SKETCH_BITS) // SLICES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "id", "n", "sig", "part", "counts"]
        for b in batches:
            n, sig, seen, held = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [], 0
            for i, tokens in shingle_sets(b.column(1), width):
                n[i], sig[i] = len(tokens), set_id(tokens)
                seen.append(tokens)
                held += len(tokens)
                if held >= 1 << 20 or i == b.num_rows - 1:
                    counts += np.bincount((np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                    seen, held = [], 0
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), b.column(0), pa.array(n), pa.array(sig), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            slices = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, span)  # a shingle's order may be any fixed function of it
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES, np.int32)), pa.array(np.arange(SLICES)), pa.array(np.ones(SLICES, np.int64)), pa.array(np.zeros(SLICES, np.int64)), pa.array(np.full(SLICES, TaskContext.get().partitionId())), pa.array([x.tobytes() for x in slices])], names)

    return docs.mapInArrow(part, "kind int, id long, n long, sig long, part long, counts binary")


def sketch(described: DataFrame) -> np.ndarray:
    """The tasks' counts added up, at most PASS of them in one task at a time; bounded by 2**SKETCH_BITS numbers."""
    slices = described.where("kind = 1").select("id", "n", "part", "counts")

    def add(key, rows):
        total = sum(np.frombuffer(c, "u1" if w == 1 else "<i8").astype("<i8") for c, w in zip(rows["counts"], rows["n"]))
        return rows.iloc[:1].assign(n=8, part=key[1], counts=[total.tobytes()])

    while True:
        parts = slices.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0]
        slices = slices.withColumn("part", F.expr(f"part div {PASS}")).groupBy("id", "part").applyInPandas(add, "id long, n long, part long, counts binary")
        if parts < PASS:
            break
        slices = as_table(slices)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    span = len(out) // SLICES
    for i, _, _, c in slices.collect():
        out[i * span : (i + 1) * span] = np.frombuffer(c, "<i8")
    return out


def postings(docs: DataFrame, shared, mean: float, width: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """(token, sig, n, pos, k): prefix shingles that may be shared by two classes, the class's size, the shingle's place in
    its order, and the classes of the posting (of its part, for frequent shingles).

    `shared` is the broadcast sketch, `mean` its mean. Postings reach a task sorted and are read batch by batch; only one
    posting is held. Sets of up to 2**27 shingles have room in `meta`: part, size, place.
    """
    bound = mean + 8 * np.sqrt(mean) + frequent
    bits = np.uint64(64 - SKETCH_BITS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_counts, known = shared.value, set()  # a task's copies of a text count once
        for b in batches:
            out: list = []
            for i, tokens in shingle_sets(b.column(0), width):
                n, sig = len(tokens), set_id(tokens)
                if n and sig not in known:
                    known.add(sig)
                    c = sketch_counts[(tokens >> bits).astype(np.int64)]
                    first = np.argsort(c, kind="stable")[: n - at_least(n, percent) + 1]
                    out.append((tokens[first], np.full(len(first), sig, np.int64), c[first], (n << 24) + np.arange(len(first))))
                if out and (len(out) == 1024 or i == b.num_rows - 1):
                    t, sigs, c, meta = map(np.concatenate, zip(*out))
                    salts = np.clip(1 + (c - mean) // frequent, 1, 4094).astype(np.uint64)
                    salt = np.where(c > bound, mix(sigs.view(np.uint64)) % salts + np.uint64(1), 0).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(sigs), pa.array(meta + (salt << 51))], ["token", "sig", "meta"])
                    out = []

    def shared_only(t, sig, meta) -> pa.RecordBatch:
        """Of whole postings in order the rows that have a neighbour of a size that may link (of frequent ones, all)."""
        n, salt = meta >> 24 & 0x7FFFFFF, meta >> 51
        new = np.ones(len(t) + 1, bool)
        new[1:-1] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
        near = np.zeros(len(t) + 1, bool)  # the row before is of this posting, and near in size
        near[1:-1] = ~new[1:-1] & (100 * n[:-1] >= percent * n[1:])
        first = np.flatnonzero(new)
        k = np.repeat(np.diff(first), np.diff(first))
        s = np.flatnonzero(near[:-1] | near[1:] | (salt > 0))
        return pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (t, sig, n, meta & 0xFFFFFF, k)], ["token", "sig", "n", "pos", "k"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            t, sig, meta = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, b.columns))
            once = np.ones(len(t), bool)
            once[1:] = (t[1:] != t[:-1]) | (sig[1:] != sig[:-1])
            t, sig, meta = t[once], sig[once], meta[once]
            last = int(np.searchsorted(t, t[-1])) if len(t) else 0  # parts of a posting stay together until it ends
            if last:
                yield shared_only(t[:last], sig[:last], meta[:last])
            held = [t[last:], sig[last:], meta[last:]]
        if len(held[0]):
            yield shared_only(*held)

    rows = docs.select("text").mapInArrow(prefixes, "token long, sig long, meta long")
    dealt = rows.repartition("token", F.shiftright("meta", 51)).sortWithinPartitions("token", "meta", "sig")
    return dealt.mapInArrow(gather, "token long, sig long, n long, pos long, k long")


def grouped(posts: DataFrame, percent: int, most: int = GROUP) -> DataFrame:
    """(sig, n, gid, slot, members, least, most): each class's group, its place there, and the group's number and range of sizes.

    A group takes classes of one leading shingle and size band, dealt by hash to parts of about half of `most` classes
    and at most GROUP_SHINGLES shingles; a part that is larger is cut. A group's id is the least of its classes.
    """
    base = max(100 / percent, 1.05)
    one = posts.groupBy("sig").agg(F.max(F.struct("k", "token")).alias("_lead"), F.min("n").alias("n"))
    band = F.floor(F.log("n") / math.log(base))
    parts = F.ceil(F.greatest(F.lit(1.0), F.col("_lead.k") * F.greatest(F.lit(2.0 / most), F.pow(F.lit(base), band) / float(GROUP_SHINGLES))))
    placed = one.select("sig", "n", F.col("_lead.token").alias("_token"), band.alias("_band"), F.pmod(F.xxhash64("sig"), parts.cast("long")).alias("_part"))
    keys = ["_token", "_band", "_part"]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("sig")) - 1
    placed = placed.withColumn("_at", at).withColumn("_cut", F.floor(F.col("_at") / most))
    whole = Window.partitionBy(*keys, "_cut")
    return placed.select("sig", "n", F.min("sig").over(whole).alias("gid"), (F.col("_at") % most).alias("slot"), F.count("*").over(whole).alias("members"), F.min("n").over(whole).alias("least"), F.max("n").over(whole).alias("most"))


def bits(masks: np.ndarray, members: int) -> np.ndarray:
    """The masks as a 0/1 matrix, a column for each member."""
    return np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :members].astype(np.float32)


def overlaps(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """[n, m]: shingles shared by members of two groups, from the masks of the shingles that both have."""
    return sum((bits(a[s : s + 65536], n).T @ bits(b[s : s + 65536], m)).astype(np.int64) for s in range(0, max(len(a), 1), 65536))


def linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (100 * shared >= percent * (n[:, None] + m[None, :] - shared)) & (shared > 0)


def matrix(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of the token-group matrix from (gid, slot, sig, text, crossed): the members' classes and sizes, for each the slot
    that represents what it links with inside the group, and, where `crossed`, the union of shingles with masks of members."""

    def build(rows: pa.Table) -> pa.Table:
        slot = rows["slot"].to_numpy()
        rows = rows.take(pa.array(np.unique(slot, return_index=True)[1]))  # a class whose row is repeated counts once
        sets = [t for _, t in shingle_sets(rows["text"], width)]
        c, sizes = len(sets), np.array([len(t) for t in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, bit = tokens[order], np.repeat(np.uint64(1) << np.arange(c, dtype=np.uint64), sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        tokens, masks = tokens[first], np.add.reduceat(bit, first)
        root = np.arange(c)
        if c > 1:
            link = linked(overlaps(masks, masks, c, c), sizes, sizes, percent) | np.eye(c, dtype=bool)
            while True:
                now = np.where(link, root[None, :], c).min(1)
                if (now == root).all():
                    break
                root = now
        if not rows["crossed"][0].as_py():
            tokens = masks = tokens[:0]
        lists = [pa.array([x.tolist() if k < 3 else x.view(np.int64)], pa.list_(pa.int64())) for k, x in enumerate((rows["sig"].to_numpy(), sizes, root, tokens, masks))]
        return pa.Table.from_arrays([rows["gid"].combine_chunks()[:1], *lists], ["gid", "sigs", "sizes", "roots", "tokens", "masks"])

    return members.groupBy("gid").applyInArrow(build, "gid long, sigs array<long>, sizes array<long>, roots array<long>, tokens array<long>, masks array<long>")


def fits(a: str, b: str, percent: int) -> Column:
    """Whether sizes from `from` to `to` of columns a and b come near enough to link."""
    return (100 * F.col(f"{a}.to") >= percent * F.col(f"{b}.from")) & (100 * F.col(f"{b}.to") >= percent * F.col(f"{a}.from"))


def room(a: str, b: str, percent: int) -> Column:
    """Whether the places of a shared shingle leave room for the overlap that the smallest sizes need."""
    want = F.expr(f"{percent} * ({a}.from + {b}.from)") / (100 + percent)
    return (F.col(f"{a}.room") >= want) & (F.col(f"{b}.room") >= want)


def candidates(columns: DataFrame, percent: int, only: DataFrame | None = None) -> DataFrame:
    """Pairs of groups (g, h) that may hold a link, from (token, gid, from, to, room, least, most, star), columns of shared
    shingles: without `only` each group with one other, the least of most of its shingles; with it (gid, only: the label
    of all its members, or null) all pairs that do not lie in one component.

    Sets that need an overlap of `want` share want - ceil(t n) + 1 prefix shingles at least, n the larger size.
    """
    t = percent / 100
    if only is None:
        met = columns.select(F.struct("gid", "from", "to", "room", "least", "most").alias("a"), F.col("star").alias("b")).where("a.gid <> b.gid")
    else:
        side = columns.join(only, "gid").select("token", F.struct("gid", "from", "to", "room", "least", "most", "only").alias("a"))
        met = side.join(side.withColumnRenamed("a", "b"), "token").where((F.col("a.gid") < F.col("b.gid")) & ~F.coalesce(F.col("a.only") == F.col("b.only"), F.lit(False)) & fits("a", "b", percent))
    need = (F.least("a.least", "b.least") - t * F.greatest("a.most", "b.most")) * (t / (1 + t)) - 1
    pairs = met.where(fits("a", "b", percent)).groupBy(F.col("a.gid").alias("g"), F.col("b.gid").alias("h")).agg(F.count("*").alias("hits"), F.max(room("a", "b", percent)).alias("room"), F.max(need).alias("need"))
    pairs = pairs.where("room and hits >= need")
    if only is None:
        return pairs.groupBy("g").agg(F.max(F.struct("hits", "h")).alias("b")).select("g", F.col("b.h").alias("h"))
    return pairs.select("g", "h")


def across(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of the pairs of groups (g, h): one for each two sets of linked members."""
    row = F.struct("sigs", "sizes", "roots", "tokens", "masks")
    groups = groups.where("size(tokens) > 0")
    both = pairs.join(groups.select(F.col("gid").alias("g"), row.alias("a")), "g").join(groups.select(F.col("gid").alias("h"), row.alias("b")), "h").select("a.*", *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("sigs", "sizes", "roots", "tokens", "masks")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                sig_a, size_a, root_a, tok_a, mask_a, sig_b, size_b, root_b, tok_b, mask_b = (c[i].values.to_numpy() for c in batch.columns)
                _, at_a, at_b = np.intersect1d(tok_a.view(np.uint64), tok_b.view(np.uint64), assume_unique=True, return_indices=True)
                a, b = mask_a.view(np.uint64)[at_a], mask_b.view(np.uint64)[at_b]
                one = np.full(len(a), 1, np.uint64)
                open_a = overlaps(a, one, len(sig_a), 1)[:, 0] >= at_least(np.maximum(size_a, size_b.min()), percent)
                open_b = overlaps(b, one, len(sig_b), 1)[:, 0] >= at_least(np.maximum(size_b, size_a.min()), percent)
                if open_a.any() and open_b.any():
                    link = linked(overlaps(a, b, len(sig_a), len(sig_b)), size_a, size_b, percent)
                    x, y = np.nonzero(link & open_a[:, None] & open_b[None, :])
                    found += zip(sig_a[root_a[x]].tolist(), sig_b[root_b[y]].tolist())
            found = list(set(found))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def join_components(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `df`; two rows link when 100 |A & B| >= percent |A | B|.

    component_id is the smallest doc_id reachable. Fewer than `width` words are one shingle; null, empty and blank texts
    have none and link with nothing; a null doc_id takes part but is no component's name unless all are null; repeated
    rows are one class; an empty table gives an empty table; other columns are ignored. Sets are told apart by 64-bit
    hashes of shingles and of sets.
    """
    named = _labelled(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    least = as_table(named.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return named.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A written table of doc_id, n_shingles, sig and label for every row of (doc_id, text): rows of one component have one label; those without shingles are not told apart."""
    described = as_table(describe(docs, width))
    rows = described.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "sig")
    counts = sketch(described)
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    posts = as_table(postings(docs, shared, float(counts.mean()), width, percent))
    shared.destroy()
    label = _labels(docs, rows, posts, width, percent)
    return as_table(rows.join(label, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "sig", F.coalesce("label", "sig").alias("label")))


def _labels(docs: DataFrame, rows: DataFrame, posts: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, label) of the classes that link with others: the smallest class reachable."""
    members = as_table(grouped(posts, percent))
    mine = members.select("sig", "gid", "least", "most")
    columns = as_table(posts.select("token", "sig", "n", "pos").join(mine, "sig").groupBy("token", "gid").agg(F.min("n").alias("from"), F.max("n").alias("to"), F.max(F.col("n") - F.col("pos")).alias("room"), F.min("least").alias("least"), F.max("most").alias("most")))
    star = F.min(F.struct("gid", "from", "to", "room", "least", "most"))
    several = columns.groupBy("token").agg(star.alias("star"), F.max("gid").alias("_last")).where("star.gid <> _last").drop("_last")
    columns = as_table(columns.join(several, "token"))

    first = as_table(candidates(columns, percent))
    crossed = _ends(first).withColumn("crossed", F.lit(True))
    wanted = members.join(crossed, "gid", "left").where("members > 1 or crossed").select("sig", "gid", "slot", F.coalesce("crossed", F.lit(False)).alias("crossed"))
    groups = as_table(matrix(_with_texts(docs, rows, wanted, width), width, percent))
    inside = groups.select("sigs", F.posexplode("roots").alias("slot", "root")).where("slot <> root").select(F.col("sigs")[F.col("slot")].alias("u"), F.col("sigs")[F.col("root").cast("int")].alias("v"))
    links = as_table(inside.unionByName(across(first, groups, percent)))
    label = as_table(components(links))

    of_group = members.select("sig", "gid").join(label.withColumnRenamed("node", "sig"), "sig", "left").groupBy("gid").agg(F.min(F.coalesce("label", "sig")).alias("a"), F.max(F.coalesce("label", "sig")).alias("b"))
    only = of_group.select("gid", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only"))
    done = first.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
    rest = as_table(candidates(columns, percent, only).join(done, ["g", "h"], "left_anti"))
    if rest.take(1):
        wanted = members.join(_ends(rest), "gid", "left_semi").select("sig", "gid", "slot", F.lit(True).alias("crossed"))
        groups = as_table(matrix(_with_texts(docs, rows, wanted, width), width, percent))
        more = as_table(across(rest, groups, percent))
        label = as_table(components(links.unionByName(more)))
    return label.select(F.col("node").alias("sig"), "label")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("g").alias("gid")).unionByName(pairs.select(F.col("h").alias("gid"))).distinct()


def _with_texts(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """`classes` (sig, ...) with the text of one row of each (repeated rows may give it twice).

    A class is found by the doc_id of a row that alone has that id; where it has none, by its set.
    """
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("_again"))
    some = bool(repeated.take(1))
    if some:
        repeated = as_table(repeated)
        rows = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_again")), "left_anti")
    one = rows.groupBy("sig").agg(F.min("doc_id").alias("_id"))
    found = as_table(classes.join(one, "sig", "left"))
    n = found.count()
    small = F.broadcast if n <= SMALL else lambda d: d
    texts = docs.join(small(found.where("_id is not null")), F.col("doc_id") == F.col("_id")).select(*classes.columns, "text")
    if not some:
        return texts

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[int, int] = {}
            for i, t in shingle_sets(b.column(0), width):
                known.setdefault(set_id(t), i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(known.values()), pa.int64())), pa.array(list(known), pa.int64())], ["text", "_set"])

    again = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_again")), "left_semi").select("text").mapInArrow(sets, "text string, _set long")
    missing = found.where("_id is null")
    more = again.join(small(missing), F.col("_set") == F.col("sig")).select(*classes.columns, "text")
    return texts.unionByName(more.groupBy(*classes.columns).agg(F.min("text").alias("text")))


def keep_one(df: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `df` (with doc_id, text) without those of which another row of their component stays: exactly one row of each.

    That is the one of the smallest doc_id; null ids come last, repeated rows (of one id, and one text if it has no
    shingles) count as one. A doc_id of a single row finds its row alone; other rows are told apart by id and set.
    """
    width = 5
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    named = _labelled(base.select(F.col("id").alias("doc_id"), "text"), width, percent)
    first = named.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sig")).alias("a")).select("a.doc_id", "a.sig")
    first = first.unionByName(named.where("n_shingles = 0").select("doc_id", "sig").distinct())
    rows = named.groupBy("doc_id").agg(F.count("*").alias("k")).where("doc_id is not null and k > 1")
    several = first.where("doc_id is not null").join(rows, "doc_id", "left").select("doc_id", "sig", F.isnotnull("k").alias("several"))
    kept = as_table(several.unionByName(first.where("doc_id is null").withColumn("several", F.lit(True))))
    alone = base.join(kept.where("not several").select(F.col("doc_id").alias("kept")), F.col("id") == F.col("kept"), "left_semi").select("row")
    kept = kept.where("several").select(F.col("doc_id").alias("kept"), F.col("sig").alias("set"))
    n = kept.count()
    if not n:
        return alone.select("row.*")
    small = F.broadcast if n <= SMALL else lambda d: d

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = pa.array([set_id(t) for _, t in shingle_sets(b.column(2), width)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, sig], [*b.schema.names, "sig"])

    near = base.join(small(kept.select("kept").distinct()), F.col("id").eqNullSafe(F.col("kept")), "left_semi").mapInArrow(sets, with_columns(base.schema, "sig long"))
    near = near.join(small(kept), F.col("id").eqNullSafe(F.col("kept")) & (F.col("sig") == F.col("set")), "left_semi")
    one = near.groupBy("id", "sig", F.when(F.col("sig") == 0, F.col("text")).alias("blank")).agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return alone.unionByName(one.select("row")).select("row.*")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS c FROM r GROUP BY u) c USING (doc_id)
"""
