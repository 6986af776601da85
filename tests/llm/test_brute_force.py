"""Operators without SQL against plain recomputation, and all of them on edge rows through Spark."""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspec.llm import ann, jaccard, language, mixing, packing, sharding, tokens, topk, toxicity

from .test_operators import SF, TEXTS, docs, ids_by_tokenizers  # noqa: F401


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


EDGE_VECTORS = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, None]), (5, [3.0, 1.0]), (6, []), (7, [3.0, 1.0]), (None, [9.0, 9.0]), (50, [1.0, 1.0]), (100, [0.0, 0.0])]


def test_top_k_edge_rows(spark, tmp_path):
    vectors(spark, EDGE_VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op2_top_k(spark, str(tmp_path)).collect())
    clean = [(i, v) for i, v in EDGE_VECTORS if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {i: v for i, v in clean if i % 50 == 0}.items():
        copies = 2 if q == 0 else 1  # a repeated query's ranking is shared by its copies
        best = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(a, v)), i) for i, v in clean if i != q for _ in range(copies))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.exact_top_k(*[spark.createDataFrame([], "id long, vec array<long>")] * 2).count() == 0


def nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
    return [(float(d[i]), int(ids[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]


def test_graph_recall_of_several_shards(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 24))
    x = (centres[r.integers(0, 40, 6000)] + 0.4 * r.standard_normal((6000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    nodes = ann.index(df, shard_size=700)
    assert nodes.select("shard").distinct().count() == 9 and nodes.count() == 6000
    got = ann.search(nodes, df.where("id % 100 = 0")).collect()
    hit = total = 0
    for q in range(0, 6000, 100):
        best = nearest(x.astype(float), np.arange(6000), q)
        mine = {r["id"]: r["score"] for r in got if r["query_id"] == q}
        hit, total = hit + len({i for _, i in best} & set(mine)), total + len(best)
        assert all(mine[i] == pytest.approx(d, rel=1e-12) for d, i in best if i in mine)
    assert hit >= 0.9 * total


@pytest.mark.parametrize(("scale", "kind"), [(1e25, "float"), (1e-30, "float"), (1e100, "double"), (1.0, "double")])
def test_graph_of_any_finite_vectors(spark, scale, kind):
    r = np.random.default_rng(6)
    x = r.standard_normal((60, 5)) * scale
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)], kind)
    v = ann.usable(df, "vec_id", "embedding")
    got = ann.search(ann.index(v), v.where("id % 100 = 0")).orderBy("rank").collect()
    best = nearest(x, np.arange(60), 0)
    assert [g["id"] for g in got] == [i for _, i in best]
    assert [g["score"] for g in got] == pytest.approx([d for d, _ in best], rel=1e-12)


def test_graph_empty_and_repeated(spark):
    v = ann.usable(vectors(spark, [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (3, [2.0, 0.5]), (3, [2.0, 0.5])]), "vec_id", "embedding")
    got = ann.search(ann.index(v), v.where("id % 100 = 0")).collect()
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == {(0, 3, 1.0)}
    none = v.limit(0)
    assert ann.search(ann.index(none), none).count() == 0


def test_sharding_of_one_text(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i}", 1, "x", "y", 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, row string, bucket string, start int").repartition(7)
    got = sharding.shard(df, sharding.spread_key(F.col("text"), F.col("doc_id")), F.octet_length("text") + 8, ["doc_id"], 5, 0.01, bucket_bytes=2000)
    assert got.columns == [*df.columns, "shard", "slot"]
    got = got.toPandas()
    assert sorted(got.doc_id) == list(range(4000))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = got.assign(n=got.text.str.len() + 8).groupby("shard").n.sum()
    assert len(size) == 5 and size.max() < 1.05 * size.min()
    out = sharding.op5_sharding(spark, SF)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["size"] == len(text[r["doc_id"]]) + 8 and r["law"] == "bytes"


def test_packing_brute_force(spark, docs):  # noqa: F811
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mine = docs.select((F.monotonically_increasing_id() + 10**6).alias("doc_id"), "text")
    for df, capacity in ((mine, 64), (table, 2048)):
        rows = df.collect()
        ids = dict(zip([r["doc_id"] for r in rows], [np.array([*x, 1], "<u4") for x in ids_by_tokenizers([r["text"] for r in rows])]))
        got = packing.pack(df, tokens.vocabulary(), capacity).collect()
        seen = {}
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for d, x in ids.items():
            at = 0
            for s, n in sorted(seen[d]):
                assert s == at
                at += n
            assert at == len(x)
        least = -(-sum(map(len, ids.values())) // capacity)
        used = max(r["sequence_id"] for r in got) + 1
        assert sorted({r["sequence_id"] for r in got}) == list(range(used))
        assert used <= least + 2  # whole windows, but for what the last ones lack


def test_token_output_rows(spark, docs, tmp_path):  # noqa: F811
    mine = docs.select((F.monotonically_increasing_id() + 10**6).alias("doc_id"), "text")
    rows = mine.collect()
    ids = dict(zip([r["doc_id"] for r in rows], [[*x, 1] for x in ids_by_tokenizers([r["text"] for r in rows])]))
    out = f"file://{tmp_path}/shards"
    got = tokens.materialise(mine, out, tokens.vocabulary(), length=32, rows_per_shard=50, tasks=3).collect()
    data = tokens.read_slots(out, 0, 10**9)
    want = {(d, s): x[s : s + 32] for d, x in ids.items() for s in range(0, len(x), 32)}
    assert {(r["doc_id"], r["start"]): data[r["slot"]][: r["length"]].tolist() for r in got} == want and len(got) == len(want)
    assert all(r["shard"] == r["slot"] // 50 for r in got) and not data[got[0]["slot"]][got[0]["length"] :].any()
    assert [r["slot"] for r in sorted(got, key=lambda r: (r["doc_id"], r["start"]))] != sorted(r["slot"] for r in got)
    manifest = json.loads((tmp_path / "shards/manifest.json").read_text())
    assert manifest["sequences"] == len(want) and len(list((tmp_path / "shards").glob("shard-*.bin"))) == manifest["shards"]
    assert not list((tmp_path / "shards").glob(".writing*"))


def plain_likelihoods(text, model):
    data = text.encode()
    letter = [b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in data]
    x = [(b + 32 if 65 <= b <= 90 else b) if ok else 32 for b, ok in zip(data, letter)]
    total, n = np.zeros(model.shape[1]), sum(letter)
    for i in range(len(x)):
        if letter[i]:
            a, c = x[i - 1] if i else 32, x[i + 1] if i + 1 < len(x) else 32
            total += model[((a << 16 | x[i] << 8 | c) * 2654435761 % (1 << 32)) >> 17]
    return total * min(1, language.EVIDENCE / n) if n else None


def test_language_brute_force(spark):
    model = language.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))
    extra = [(-1, None, None), (-2, "https://a.example.de/x", ""), (-3, "nonsense", "<b>12 34</b>"), (-3, "nonsense", "<b>12 34</b>"), (-4, "http://A.B.C.fr:80/", "<html lang=fr>und das ist nicht gut</html>")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rows, weight = [], language.WEIGHT
    for r in pages.collect():
        html = r["html"] or ""
        text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", html)
        found = re.search(r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", html)
        at = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", r["url"] or "")
        host = at[1].lower() if at else ""
        parts = host.split(".")
        rows.append((r["page_id"], host, ".".join(parts[-2:]), parts[-1], found[1].lower() if found else "", plain_likelihoods(text, model)))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n = model.shape[1]

    def sums(k):
        out = {}
        for r in rows:
            if r[5] is not None:
                key = r[1:4] if k == 1 else r[k]
                out[key] = out.get(key, 0) + soft(r[5])
        return out

    host, domain, suffix, declared = (sums(k) for k in (1, 2, 3, 4))
    whole = sum(suffix.values())
    smooth = lambda s, to: (s + weight * to) / (s.sum() + weight)
    corpus = smooth(whole, np.full(n, 1 / n))
    seen = lambda s: np.log((s + weight * s.sum() / max(whole.sum(), 1)) / (whole + weight))
    want = []
    for page, h, d, s, lang, ll in rows:
        if ll is None:
            want.append((page, "und", 1.0))
        else:
            prior = smooth(np.maximum(host[h, d, s] - soft(ll), 0), smooth(domain[d], corpus))
            post = soft(ll + np.log(prior) + seen(suffix[s]) + seen(declared[lang]))
            want.append((page, [*language.LANGUAGES, "und"][int(post.argmax())], float(post.max())))
    got = sorted((r["page_id"], r["language"], r["probability"]) for r in language.identify_pages(pages, model).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 0")
    model = language.fit_on(df.where("doc_id % 2 = 0"))
    rows = [(r["lang"], plain_likelihoods(r["text"][:400], model)) for r in df.where("doc_id % 2 = 1").collect() if r["lang"] in language.LANGUAGES]
    rows = [(a, b) for a, b in rows if b is not None]
    right = np.mean([language.LANGUAGES[int(b[:4].argmax())] == a for a, b in rows])
    print("language accuracy", len(rows), right)
    assert right > 0.95


def plain_score(net, text):
    """The text's score, a window at a time and a word at a time."""
    words = [w.encode().lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0.0
    vec = []
    for w in words:
        data, at = toxicity.text_buffers(pa.array([w.decode()]))
        one = toxicity.read_words(data, at)
        vec.append(np.concatenate([net.p["word"][one.word[0]], net.p["gram"][one.gram].sum(0) / np.sqrt(max(1, len(one.gram)))]))
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, size, step = toxicity.HIDDEN, toxicity.WINDOW, toxicity.STRIDE
    starts = [0] if len(words) <= size else sorted({*range(0, len(words) - size, step), len(words) - size})
    best = -np.inf
    for s in starts:
        x, states = vec[s : s + size], []
        for k in "fb":
            now, out = np.zeros(h), []
            for v in x if k == "f" else x[::-1]:
                g = v @ net.p[f"in_{k}"] + net.p[f"bias_{k}"]
                zr = sig(g[: 2 * h] + now @ net.p[f"re_{k}"][:, : 2 * h])
                c = np.tanh(g[2 * h :] + (zr[h:] * now) @ net.p[f"re_{k}"][:, 2 * h :])
                now = now + zr[:h] * (c - now)
                out.append(now)
            states.append(out if k == "f" else out[::-1])
        state = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
        a = np.exp(state @ net.p["attend"])
        best = max(best, float((a / a.sum()) @ state @ net.p["out"] + net.p["shift"][0]))
    return 1 / (1 + np.exp(-best))


def test_toxicity_windows(spark):
    net, r = toxicity.Network(4), np.random.default_rng(2)
    net.p["out"] *= 8
    texts = [None, "", " \n", "One wörd", *[" ".join(f"w{i}" for i in r.integers(0, 300, n)) for n in (5, 31, 32, 33, 47, 48, 49, 200)]]
    got = toxicity.score_texts(net, pa.array(texts, pa.string()))
    assert got == pytest.approx([plain_score(net, t or "") for t in texts], abs=1e-4)


def test_toxicity_fit_on_repeated_ids(spark):
    rows = [(1, "bad word here")] * 40 + [(i, f"fine words {i}") for i in range(2, 30)] + [(None, "no id"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)] * 2 + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    a, b = (toxicity.fit_on(d, labels) for d in (df, df.dropDuplicates()))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    assert toxicity.score_texts(toxicity.fit_on(df.limit(0), labels.limit(0)), pa.array(["x"]))[0] < toxicity.THRESHOLD


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, key int, size int, label string, sig long, gid long, _kept int, score double, hash int, _part int, length long, probability double"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i if i % 9 else None, t, ["de", None, "en"][i % 3], [None, "a"][i % 2], i, "r", None, 1, 2, "l", 3, 4, 5, 6.0, 7, 8, 9, 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[3:9], CLASHING).repartition(3)


def test_clashing_columns(spark, clashing):
    model = language.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.shape[1] == 5
    kept = language.keep_languages(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()
    assert kept.where("text is null or trim(text) = ''").count() == 0
    net = toxicity.Network()
    assert toxicity.scored(clashing, net).count() == clashing.count()
    one = jaccard.keep_one(clashing)
    assert one.columns == clashing.columns and one.count() == one.distinct().count()
    mix = mixing.mix(clashing)
    assert mix.count() == clashing.count() and mix.where("taken > 3 * size").count() == 0
    assert sharding.shard(clashing, F.col("doc_id"), F.col("n_chars"), ["doc_id"], 3).count() == clashing.count()
    assert packing.pack(clashing, tokens.vocabulary(), 64).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


def test_pipeline_stages(spark, clashing):
    import corpus_pipeline as p

    docs_, columns = clashing, p.COLUMNS
    for name, stage in p.STAGES:
        for df in (docs_, docs_.limit(0)):
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == columns
            n = out.count()
            assert (n > 0) == (df is docs_)
        if name == "language_id":
            assert out is not None and stage(spark, docs_, SF).where("text is null or not text rlike '[a-zA-Z]'").count() == 0
        if name == "ngram_jaccard":
            found = {r["component_id"] for r in jaccard.join_components(docs_).collect()}
            assert n == 0 and stage(spark, docs_, SF).count() >= len(found) - 1


@pytest.mark.parametrize("share", [0.3, 0.9])
def test_jaccard_hot_cluster(spark, share):
    """A cluster larger than a group, of which a part links with nothing, beside copies and a passage that many share."""
    r = np.random.default_rng(9)
    base, passage = [f"b{i}" for i in range(150)], " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(230):
        w = list(base)
        for j in r.choice(150, 2 if r.random() < share else 5, replace=False):
            w[j] = f"x{i}_{j}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 200 + [f"{passage} " + " ".join(f"q{i}_{j}" for j in range(14)) for i in range(150)] + [f"{passage} u{i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x["doc_id"]: x["component_id"] for x in jaccard.join_components(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
