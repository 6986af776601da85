"""Each operator against SQL or brute force, with nulls, empties, long texts, ties, repeated rows and clashing columns."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspec.llm import ann, chat, jaccard, language, mixing, packing, queries, sharding, tokens, topk, toxicity
from lumenspec.llm.common import components

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n", "one", "a b c d", "a  b c  d", "A b c d e f", "a B c d e f", "a b c d e f g", "Grüße an　alle   x\n\ny  z\n", "don't\n 's it's\t1,000.5  ", "word " * 30000, "émoi 漢字 😀 " * 50] + [f"w{i} x{i} common line of words" for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, ["de", None, "en"][i % 3], [None, "s1", "s2", "s3"][i % 4], 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[3:6], "doc_id long, text string, lang string, source string, size int, shard int")


def compare(spark, name):
    df, con = queries.QUERIES[name](spark, SF), duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    a = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    b = sorted((tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()), key=repr)
    assert a == b and a


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    compare(spark, name)


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_top_k_brute_force():
    r = np.random.default_rng(5)
    x = r.integers(-9, 9, (700, 8))
    ids = np.arange(700)
    x[100:300] = x[5]
    for q, (got, score) in zip(range(9), topk.no_random_access(x[:9], ids[:9], topk.Lists(x, ids), 5, 8)):
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert list(got) == best and list(score) == list(s[best])


@pytest.mark.parametrize("scale", [50_000, 1 << 26, 1 << 29])
def test_top_k_near_ties_of_large_vectors(scale):
    r = np.random.default_rng(8)
    half = r.integers(-scale, scale, 32)
    q = np.concatenate([[1], half, half])[None, :]
    noise = r.integers(-scale, scale, (3000, 32))
    x = np.concatenate([r.permutation(3000)[:, None], half + noise, half - noise], axis=1)  # scores differ by 1
    ids = np.arange(3000)
    exact = x.astype(object) @ q[0].astype(object)
    best = sorted(range(3000), key=lambda i: (-exact[i], i))[:5]
    if exact[best[0]] >= 1 << 63:
        with pytest.raises(OverflowError):
            topk.no_random_access(q, np.array([-1]), topk.Lists(x, ids), 5)
    else:
        [(got, score)] = topk.no_random_access(q, np.array([-1]), topk.Lists(x, ids), 5)
        assert got.tolist() == best and score.tolist() == [exact[i] for i in best]


def test_top_k_large_components(spark, tmp_path):
    x = [[float(1 << 23), 1.0], [float(3 << 22), 0.5], [-float(1 << 23), 2.0], [1.0, float(1 << 24)]]
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x[0], x[i])), i) for i in (1, 2, 3))
    got = topk.op2_top_k(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(-r["score"], r["vec_id"]) for r in got] == want


def ids_by_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encode():
    texts = [*TEXTS, "<|endoftext|> x", "a\u0085b   c", "x\r\n y", " lead", "trail "]
    got = dict(tokens.encode(pa.array(texts, pa.string()), tokens.vocabulary()))
    assert [got[i].tolist() for i in range(len(texts))] == ids_by_tokenizers(texts)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000])
def test_feistel(n):
    assert sorted(tokens.feistel(np.arange(n), n, 7)) == list(range(n))


def test_materialise(spark, docs, tmp_path):
    out = f"file://{tmp_path}/shards"
    rows = tokens.materialise(docs, out, tokens.vocabulary(), length=16, rows_per_shard=64).collect()
    data = tokens.read_slots(out, 0, 10**9)
    assert sorted(r["slot"] for r in rows) == list(range(len(data)))
    for r in rows:
        assert zlib.crc32(data[r["slot"]][: r["length"]].tobytes()) == r["ids_crc32"]
    want = sum(-(-(len(x) + 1) // 16) for x in ids_by_tokenizers([r["text"] for r in docs.collect()]))
    assert len(rows) == want
    assert (tokens.read_slots(out, 70, 5) == data[70:75]).all()
    assert tokens.materialise(docs.limit(0), f"file://{tmp_path}/none", tokens.vocabulary()).count() == 0


def test_packing(spark, docs):
    rows = packing.pack(docs, tokens.vocabulary(), 64).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.sum() <= 64).all()
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.length.sum() == sum(len(x) + 1 for x in ids_by_tokenizers([r["text"] for r in docs.collect()]))
    assert packing.pack(docs.limit(0), tokens.vocabulary()).count() == 0


def test_fill_is_closest():
    r = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(x): int(r.integers(1, 4)) for x in r.integers(1, 30, 4)}
        room = int(r.integers(1, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        used = packing.fill(counts, room)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in used.items())


def test_sharding(spark, docs):
    text = F.coalesce("text", F.lit(""))
    got = sharding.shard(docs, sharding.spread_key(text, F.col("doc_id")), F.octet_length(text), ["doc_id"], 3, 0.01).toPandas()
    assert len(got) == docs.count() and got.columns.tolist().count("shard") == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(docs.limit(0), F.lit(0), F.lit(1), ["doc_id"]).count() == 0
    rows = sharding.op5_sharding(spark, SF).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 2 * rows["size"].max()


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_brute_force(spark):
    r = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in r.integers(0, 500, 60)) for _ in range(12)]
    texts = list(TEXTS[:10])
    for b in base:
        for _ in range(12):
            w = b.split()
            for j in r.integers(0, 60, r.integers(0, 5)):
                w[j] = f"z{r.integers(0, 9)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join_components(df).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.join_components(df.limit(0)).count() == 0


def test_jaccard_edge_rows(spark, docs):
    assert jaccard.join_components(docs).count() == docs.count()


def test_keep_one_of_each(spark):
    one, other, third, only = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    rows = [(1, one, "x"), (1, one, "x"), (2, one, "x")]  # repeated rows
    rows += [(5, other, "x"), (6, other, "x"), (6, third, "x"), (4, third, "x")]  # id 6 is in two components, each of which keeps another id
    rows += [(9, "z y x w v u", "x"), (9, "1 2 3 4 5 6", "x")]  # one id, two components
    rows += [(None, only, "x"), (None, only.upper(), "x"), (None, one, "x"), (None, "k k l l m m", "x")]
    rows += [(None, None, "x"), (None, None, "x"), (7, "", "x"), (7, "", "x"), (7, " ", "x"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = [(1, one), (5, other), (4, third), (9, "z y x w v u"), (9, "1 2 3 4 5 6"), (None, only.upper()), (None, "k k l l m m"), (None, None), (7, ""), (7, " "), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_components(spark, block):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 103), (103, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in components(edges, block=block).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 103: 100}


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (None, None, None, "x"), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.renderings(chat.perspectives(df, block=1)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann_view = got[1, "ann"]
    assert ann_view["text"].startswith("<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n")
    assert [ann_view["text"][s["start"] : s["end"]] for s in ann_view["spans"]] == ["hi<|end|>\n"]
    assert chat.perspectives(df.limit(0)).count() == 0


def test_toxicity_gradients():
    net, r = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    column = pa.array(["ab cde fgh ij", "xyz ab"], pa.string())
    data, offsets = toxicity.text_buffers(column)
    w = toxicity.read_words(data, offsets)
    text, start, size = toxicity.windows(w.row)
    at, label = toxicity.cells(w, start), np.array([1.0, 0.0])
    g = net.gradients(w, at, size, label)

    def loss():
        z = net.forward(net.tables(net.inputs(w).astype(np.float64)), at, size).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    for k in ("out", "attend", "re_f", "in_b"):
        i = tuple(r.integers(0, n) for n in net.p[k].shape)
        net.p[k][i] += 1e-2
        up = loss()
        net.p[k][i] -= 2e-2
        slope = (up - loss()) / 2e-2
        net.p[k][i] += 1e-2
        assert slope == pytest.approx(g[k][i], abs=2e-4)


def test_toxicity_held_out(spark, docs):
    r = np.random.default_rng(4)
    plain = [" ".join(f"w{x}" for x in r.integers(0, 90, 70)) for _ in range(400)]
    label = [i % 2 for i in range(400)]
    texts = [t.replace("w7", "nastyish") if y else t.replace("w7", "w8") for t, y in zip(plain, label)]
    net = toxicity.fit(texts[:300], label[:300], passes=6)
    score = toxicity.score_texts(net, pa.array(texts[300:]))
    assert np.mean((score >= toxicity.THRESHOLD) == (np.array(label[300:]) == 1)) > 0.9
    got = toxicity.scored(docs, net)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.scored(docs.limit(0), net).count() == 0


def test_graph_recall(spark):
    rows = topk.finite(F.col("embedding"))
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where(rows).toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = ann.op10_ann_graph(spark, SF).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len(set(best) & set(got[got["query_id"] == q]["vec_id"])), total + len(best)
    assert hit >= 0.9 * total


def test_graph_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = ann.usable(df, "vec_id", "embedding")
    got = ann.search(ann.index(v), v.where("id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 1), (0, 100), (0, 7), (100, 0), (100, 1), (100, 7)]


def test_language(spark, docs):
    labelled = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_on(labelled)
    pages = spark.createDataFrame([(1, "https://a.example.de/x", "<html lang='de'><p>" + "und der die nicht ein schen " * 9), (2, None, None), (3, "nonsense", "<b>12 34</b>"), (3, "", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["language"]) for r in language.identify_pages(pages, model).collect())
    assert got == [(1, "de"), (2, "und"), (3, "und"), (3, "und")]
    assert language.identify_pages(pages.limit(0), model).count() == 0
    kept = language.keep_languages(labelled)
    assert kept.columns == labelled.columns and kept.count() == labelled.count()
    assert language.keep_languages(docs).count() <= docs.count()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "mixing", "packing"]
    out = p.run(spark, SF)
    assert out.count() > 0 and out.join(docs, "doc_id", "left_anti").count() == 0
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(docs).collect()}
    kept = [r["doc_id"] for r in p.one_of_near_copies(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(set(found.values()))
