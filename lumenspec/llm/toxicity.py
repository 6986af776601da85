"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a hashed embedding of the word with the mean of hashed embeddings of its character n-grams, so
unseen inflections of a known word are recognised. Both directions' gated recurrent units read a window of words;
attention weighs their states; the pooled state gives the window's score. Windows overlap by half and cover every text
to its end; a text's score is its highest window's. Inputs depend on the text alone.

The network is fitted by one task on a bounded sample of labelled rows (SAMPLE toxic and CLEAN times as many clean
ones, each of at most SAMPLE_CHARS characters); the driver sees its parameters alone. A toxic text's label holds for it as a whole, so after the first pass only its windows with the
highest score are taught as toxic. Scoring runs in Spark tasks over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, span_hashes, text_buffers, with_columns, word_spans

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 14, 1 << 16, 4, 8, 8
GRAMS = (4, 5)
BLOCK = 1 << 14  # distinct words whose n-grams are gathered at a time
SAMPLE, CLEAN, SAMPLE_CHARS = 1000, 3, 8000  # toxic rows, clean rows for each of them, and the longest text that the fit may use
THRESHOLD = 0.3


@dataclass
class Words:
    """Distinct words of some texts and where they stand: per word its embedding row and its n-grams, as ragged rows."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray  # of each word's n-grams, and the end
    at: np.ndarray  # the words of all texts in turn, as places in `word`
    row: np.ndarray  # edges of the texts in `at`


def grams_of(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the character n-grams of words data[s:e], in the words' order, and how many each word has."""
    n = e - s
    edge = np.concatenate([[0], np.cumsum(n + 2)])  # each word between two marks
    padded = np.full(edge[-1], 1, np.uint64)
    place = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)) + 1, n)
    padded[place] = data[place + np.repeat(s - edge[:-1] - 1, n)]
    owner = np.repeat(np.arange(len(n)), n + 2)
    gram, who = [], []
    for k in GRAMS:
        m = len(padded) - k + 1
        if m > 0:
            h = np.full(m, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + padded[j : j + m]
            inside = owner[:m] == owner[k - 1 :]
            gram.append((mix(h[inside]) % np.uint64(GRAM_ROWS)).astype(np.int32))
            who.append(owner[:m][inside])
    gram, who = (np.concatenate(gram), np.concatenate(who)) if gram else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return gram[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(n))


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie one after another in `data`; hashes are taken by chunks, which bounds their running sums."""
    data, found = LOWER[data], [np.zeros((4, 0), np.int64)]
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, row = word_spans(part, offsets[a : b + 1] - offsets[a])
        found.append(np.stack([starts + offsets[a], ends + offsets[a], row + a, span_hashes(part, starts, ends).view(np.int64)]))
    starts, ends, row, spans = np.concatenate(found, axis=1)
    hashes, index, at = np.unique(spans.view(np.uint64), return_index=True, return_inverse=True)
    s, e = starts[index], ends[index]
    found = [grams_of(data, s[k : k + BLOCK], e[k : k + BLOCK]) for k in range(0, len(s), BLOCK)]
    gram, count = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    return Words((hashes % np.uint64(WORD_ROWS)).astype(np.int64), gram, first, at.ravel(), np.searchsorted(row, np.arange(len(offsets))))


def windows(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the windows of texts whose words lie between edges; the last ends with its text."""
    n = np.diff(edges)
    count = np.where(n == 0, 0, 1 + -(-np.maximum(0, n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(nth * STRIDE, np.maximum(0, n[text] - WINDOW))
    return text, edges[text] + start, np.minimum(WINDOW, n[text])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Parameters p: word, gram (embeddings), in_d, re_d, bias_d (a GRU's three gates, direction d), attend, out, shift."""

    def __init__(self, seed: int = 11) -> None:
        r, d = np.random.default_rng(seed), WORD_DIM + GRAM_DIM
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, WORD_DIM, s=0.1), "gram": draw(GRAM_ROWS, GRAM_DIM, s=0.3), "attend": draw(2 * HIDDEN, s=0.3), "out": draw(2 * HIDDEN, s=0.3), "shift": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"in_{k}": draw(d, 3 * HIDDEN, s=0.4), f"re_{k}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"bias_{k}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, w: Words) -> np.ndarray:
        n, out = np.diff(w.first), np.zeros((len(w.word), WORD_DIM + GRAM_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][w.word]
        for a in range(0, len(n), BLOCK):
            first, some = w.first[a : a + BLOCK + 1], n[a : a + BLOCK, None]
            rows = np.concatenate([self.p["gram"][w.gram[first[0] : first[-1]]], np.zeros((1, GRAM_DIM), np.float32)])
            sums = np.add.reduceat(rows, first[:-1] - first[0], axis=0)
            out[a : a + BLOCK, WORD_DIM:] = np.where(some > 0, sums / np.sqrt(np.maximum(some, 1)), 0)
        return out

    def forward(self, tables: dict[str, np.ndarray], at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; at [windows, WINDOW] are places in the tables of gate inputs. keep: also what backward needs."""
        b, t, h = len(at), int(size.max()), HIDDEN
        states = np.zeros((t, b, 2 * h), np.float32)
        steps: dict = {}
        for k, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            now, re = np.zeros((b, h), np.float32), self.p[f"re_{k}"]
            for i in order:
                live = (i < size)[:, None]
                x = tables[k][at[:, i]]
                zr = sigmoid(x[:, : 2 * h] + now @ re[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + (r * now) @ re[:, 2 * h :])
                new = np.where(live, now + z * (c - now), now)
                if keep:
                    steps[k, i] = now, z, r, c, live
                now = new
                states[i, :, : h] = now if k == "f" else states[i, :, : h]
                if k == "b":
                    states[i, :, h:] = now
        a = states @ self.p["attend"]
        a = np.where(np.arange(t)[:, None] < size[None, :], a, -np.inf)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logit = pooled @ self.p["out"] + self.p["shift"]
        return (logit, states, steps, a, pooled) if keep else logit

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"in_{k}"] + self.p[f"bias_{k}"] for k in "fb"}

    def gradients(self, w: Words, at: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over windows; at are places in w.word."""
        h, x = HIDDEN, self.inputs(w)
        tables = self.tables(x)
        logit, states, steps, a, pooled = self.forward(tables, at, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        d = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["shift"][0], g["out"] = d.sum(), pooled.T @ d
        d_pool = d[:, None] * self.p["out"]
        d_a = np.einsum("tbh,bh->tb", states, d_pool)
        d_a = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", d_a, states)
        d_states = a[:, :, None] * d_pool[None] + d_a[:, :, None] * self.p["attend"]
        d_x, t = np.zeros_like(x), len(states)
        seen = at[:, :t].T.ravel()
        order_seen = np.argsort(seen, kind="stable")
        used, first_seen = np.unique(seen[order_seen], return_index=True)
        for k, order, part in (("f", range(t - 1, -1, -1), slice(0, h)), ("b", range(t), slice(h, 2 * h))):
            re, back, d_table = self.p[f"re_{k}"], np.zeros((len(at), h), np.float32), np.zeros_like(tables[k])
            all_gates = np.zeros((t, len(at), 3 * h), np.float32)
            for i in order:
                now, z, r, c, live = steps[k, i]
                back = back + d_states[i][:, part]
                d_c = back * z * (1 - c * c) * live
                d_z = back * (c - now) * z * (1 - z) * live
                d_rn = d_c @ re[:, 2 * h :].T
                d_r = d_rn * now * r * (1 - r)
                gates = all_gates[i]
                gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :] = d_z, d_r, d_c
                g[f"re_{k}"][:, : 2 * h] += now.T @ gates[:, : 2 * h]
                g[f"re_{k}"][:, 2 * h :] += (r * now).T @ d_c
                back = np.where(live, back * (1 - z) + d_rn * r + gates[:, : 2 * h] @ re[:, : 2 * h].T, back)
            d_table[used] = np.add.reduceat(all_gates.reshape(-1, 3 * h)[order_seen], first_seen, axis=0)
            g[f"in_{k}"], g[f"bias_{k}"] = x.T @ d_table, d_table.sum(0)
            d_x += d_table @ self.p[f"in_{k}"].T
        g["word"] = w.word, d_x[:, :WORD_DIM]
        n = np.diff(w.first)
        g["gram"] = w.gram, np.repeat(d_x[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
        return g


class Adam:
    """Adam; embeddings are updated in the rows that a batch touched."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, v in g.items():
            m, s = self.m[k]
            rows: object = slice(None)
            if isinstance(v, tuple):
                rows, back = np.unique(v[0], return_inverse=True)
                v = np.stack([np.bincount(back, v[1][:, j], minlength=len(rows)) for j in range(v[1].shape[1])], 1).astype(np.float32)
            m[rows] = 0.9 * m[rows] + 0.1 * v
            s[rows] = 0.999 * s[rows] + 0.001 * v * v
            self.net.p[k][rows] -= self.rate * fix * m[rows] / (np.sqrt(s[rows]) + 1e-8)


def part_of(w: Words, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words that a batch uses, and its places among them."""
    some, back = np.unique(at, return_inverse=True)
    n = np.diff(w.first)[some]
    gram = w.gram[np.repeat(w.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return Words(w.word[some], gram, np.concatenate([[0], np.cumsum(n)]), back, w.row), back.reshape(at.shape)


def cells(w: Words, start: np.ndarray) -> np.ndarray:
    """Places of the words of windows; beyond a window's end they repeat the last word, and are not read."""
    return w.at[np.minimum(start[:, None] + np.arange(WINDOW), len(w.at) - 1)]


def fit(texts: list[str], toxic: list[int], passes: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 11) -> Network:
    """Train on whole texts; the scores are then shifted so that THRESHOLD parts the classes best on these texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    label = np.array(toxic, np.float32)
    w = read_words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    text, start, size = windows(w.row)
    if not len(text) or not 0 < label.sum() < len(label):
        net.p["out"][:] = 0
        net.p["shift"][:] = -2
        return net
    adam = Adam(net, rate)
    for k in range(passes):
        if k:
            score = logits(net, w, start, size)
            best = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(best, text, score)
            use = np.flatnonzero((label[text] == 0) & ((score > -4) | (rng.random(len(text)) < 0.1)) | (label[text] == 1) & (score >= best[text] - 0.5))
        else:
            use = np.flatnonzero((label[text] == 1) | (rng.random(len(text)) < 0.4))
        one, zero = use[label[text[use]] == 1], use[label[text[use]] == 0]
        use = rng.permutation(np.concatenate([zero, one, rng.choice(one, max(0, len(zero) // 2 - len(one))) if len(one) else one]).astype(np.int64))
        for s in range(0, len(use), batch):
            b = use[s : s + batch]
            own, at = part_of(w, cells(w, start[b]))
            adam.step(net.gradients(own, at, size[b], label[text[b]]))
    best = np.full(len(texts), -20.0, np.float32)
    np.maximum.at(best, text, logits(net, w, start, size))
    order = np.argsort(-best)
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + label.sum())
    top = int(f1.argmax())
    cut = (best[order[top]] + best[order[min(top + 1, len(order) - 1)]]) / 2
    net.p["shift"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return net


def logits(net: Network, w: Words, start: np.ndarray, size: np.ndarray, batch: int = 4096) -> np.ndarray:
    tables = net.tables(net.inputs(w))
    out = np.zeros(len(start), np.float32)
    order = np.argsort(size, kind="stable")
    for s in range(0, len(order), batch):
        b = order[s : s + batch]
        out[b] = net.forward(tables, cells(w, start[b]), size[b])
    return out


def score_texts(net: Network, column: pa.Array) -> np.ndarray:
    """Scores 0 to 1 of whole texts; null, empty and blank texts: 0."""
    data, offsets = text_buffers(column)
    out = np.zeros(len(offsets) - 1, np.float64)
    for a, b in chunks(offsets):
        w = read_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        text, start, size = windows(w.row)
        if len(text):
            best = np.full(b - a, -np.inf, np.float32)
            np.maximum.at(best, text, logits(net, w, start, size))
            out[a:b] = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -500, 500))), 0)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    """Fit on at most `sample` toxic and CLEAN * sample clean rows, the first by a hash of their id, none of them held out.

    Candidates are 5 / 4 as many labelled ids, so that long texts and ids without a text may drop out; only their texts
    are read, through a broadcast of these few ids, and of repeated ids one text each (the first by order) is used.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    known = known.withColumn("_h", F.xxhash64("_id"))
    some = [known.where(F.col("_toxic") == c).orderBy("_h", "_id").limit(n + n // 4) for c, n in ((1, sample), (0, CLEAN * sample))]
    texts = df.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).where(F.length("_text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), F.col("_own") == F.col("_id")).groupBy("_toxic", "_h", "_id").agg(F.min("_text").alias("_text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((int(c), h, t) for b in batches for c, h, t in zip(*(x.to_pylist() for x in b.columns)))
        used = [x for c, n in ((1, sample), (0, CLEAN * sample)) for x in [r for r in found if r[0] == c][:n]]
        net = fit([r[2] for r in used], [r[0] for r in used])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["parameters"])

    fitted = rows.select("_toxic", "_h", "_text").repartition(1).mapInArrow(train, "parameters binary").first()
    net = Network()
    if fitted:
        net.p = pickle.loads(fitted["parameters"])
        return net
    return fit([], [])


def scored(df: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows of `df` with a column `out`, the score of the whole text; a column of that name gives way.

    Null, empty and blank texts score 0; repeated rows score alike; an empty table gives an empty table.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    place = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(shared.value, b.column(place)))], [*b.schema.names, out])

    return df.mapInArrow(score, with_columns(df.schema, f"`{out}` double"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, net).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
