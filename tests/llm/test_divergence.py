"""The audit of sources against plain counting in Python integers."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenspec.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "q" * 90
ROWS = [
    (1, "The cat, the CAT; a dog", "en", "s1"), (2, "the cat sat", "en", "s2"), (3, "The dog sat. the the", "en", "s1"), (4, None, "en", "s3"), (5, "", None, None),
    (6, "Straße ÉCOLE école 漢字 漢字", "de", "s1"), (7, "straße ECOLE 漢字", "de", "s2"), (8, "Straße don't x2y école", "de", None), (9, "straße", "de", ""), (10, "once", "fr", "s1"), (11, None, "fr", "s2"),
    (None, f"cat sat {LONG} on_the-mat", "en", "s2"), (12, f"{LONG} {LONG} mat", "en", "s4"), (13, f"a {LONG} mat on", "en", "s4"), (14, "mat a on " * 3000, "en", "s1"),
]
ROWS += ROWS[1:3]
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, least=3, most=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    df = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept: dict = {lang: [t for (x, t), n in df.items() if x == lang and n >= least] for lang, _, _ in docs}
    groups = {(lang, s): Counter() for lang, s, _ in docs}
    for lang, s, terms in docs:
        groups[lang, s].update(t for t in terms if t in set(kept[lang]))
    whole = {lang: sum((c for (x, _), c in groups.items() if x == lang), Counter()) for lang in kept}
    share = lambda c, lang: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept[lang]}
    gap = lambda p, q: (p - q) ** 2 // q
    p, q = {g: share(c, g[0]) for g, c in groups.items()}, {lang: share(c, lang) for lang, c in whole.items()}
    out = []
    for (lang, s), c in groups.items():
        pairs = [(other, sum(gap(p[lang, s][t], p[lang, other][t]) for t in kept[lang])) for x, other in groups if x == lang and other != s]
        terms = [(t, gap(p[lang, s][t], q[lang][t])) for t in kept[lang] if c[t] and p[lang, s][t] > q[lang][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("head, longest, flush", [(D.HEAD, D.LONGEST, D.FLUSH), (30, 64, 4), (0, 64, 1)])
def test_brute_force(spark, monkeypatch, head, longest, flush):
    """All terms in one automaton; most of them in the parts of the rest; all of them there."""
    monkeypatch.setattr(D, "FLUSH", flush)
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3)
    if not head:
        head, longest = 40, -1
    assert rows_of(D.divergence(df, head_bytes=head, longest=longest)) == brute(ROWS)


@pytest.mark.parametrize("gather, flush, words", [(0, 1, 1), (20, 6, 10**6), (200, 10**6, 8)])
def test_words_are_read_once(spark, monkeypatch, gather, flush, words):
    """However often texts repeat a word, an automaton reads it once; what is gathered, added up and flushed changes no count."""
    for k, v in (("GATHER", gather), ("FLUSH", flush), ("WORDS", words)):
        monkeypatch.setattr(D, k, v)
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).coalesce(1)
    assert rows_of(D.divergence(df, head_bytes=30)) == brute(ROWS)


def test_automaton_reads_distinct_words(spark, tmp_path):
    seen = tmp_path / "read"

    class Told:
        def __init__(self, found):
            self.found = found

        def iter(self, text):
            with seen.open("a") as f:
                f.write(text + "\n")
            return self.found.iter(text)

    def automata(key, shared):
        return {lang: (ids, Told(D.automaton(terms)), [t.encode() for t in terms]) for lang, (ids, terms) in shared.value.items()}

    old, D._automata = D._automata, automata
    try:
        texts = spark.createDataFrame([(1, "en", "mat a on " * 3000), (2, "en", "on mat mat")], "g long, lang string, text string").coalesce(1)
        kept = spark.createDataFrame([(7, "en", "mat"), (8, "en", "on")], "t long, lang string, term string")
        recount = D.recount(texts, kept)
        assert sorted(tuple(r)[:3] for r in recount.collect()) == [(1, 7, 3000), (1, 8, 3000), (2, 7, 2), (2, 8, 1)]
        assert sorted(seen.read_text().split()) == ["a", "mat", "on"]
    finally:
        D._automata = old


def test_limits_and_empty(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 3)
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    assert rows_of(D.divergence(df, 1, 2)) == brute(ROWS, 1, 2)
    assert D.divergence(df.limit(0)).count() == 0
    none = [r for r in ROWS if r[2] == "fr"]
    assert rows_of(D.divergence(df.where("lang = 'fr'"))) == brute(none) == [("fr", "s1", "pair", "s2", 0, 1), ("fr", "s2", "pair", "s1", 0, 1)]


def test_shares_of_large_counts(spark):
    counts = [(0, 1), (7, 8), (10**14, 2 * 10**14 + 1), (8 * 10**15 - 1, 9 * 10**15 // 1), (3, 10**15)]
    got = spark.createDataFrame(counts, "c long, t long").select("c", "t", D._share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] for r in got)


def test_frequencies_are_of_documents(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    got = {(r["lang"], r["term"]): r["docs"] for r in D.document_frequencies(df.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")).collect()}
    assert got["en", "the"] == 6 and got["en", LONG] == 3 and got["de", "straße"] == 4 and got["de", "École".translate(LOWER)] == 1
