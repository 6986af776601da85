"""Repeats of texts against a search of all substrings."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspec.llm import repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, least):
    """The measures by comparing every two places of a text."""
    words = WORD.findall(text or "")
    n = len(words)
    three = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    longest, covered = 0, set()
    common = np.zeros((n + 1, n + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, i, -1):
            if words[i] == words[j]:
                common[i, j] = common[i + 1, j + 1] + 1
                if common[i, j] >= 3:
                    longest = max(longest, common[i, j])
                if common[i, j] >= least:
                    covered |= {a + k for a in (i, j) for k in range(common[i, j])}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    spans = [(a, b) for a in sorted(covered) if a - 1 not in covered for b in [next(e for e in range(a, n + 1) if e not in covered)]]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), int(longest), len(covered), spans)


def texts():
    r = np.random.default_rng(3)
    some = [None, "", " \n\t", "one", "a a", "a a a", "a a a a a", "Ha ha Ha ha\nHa ha\n\nHa ha ", "é 漢字 😀 é 漢字 😀 é", "#*$ %&|<> #*$ %&|<> x", "x\x0by\x0cz\x1fw x\x0by\x0cz\x1fw"]
    some += [" ".join(r.choice(list("abc"), k)) for k in (20, 60, 90)]
    some += [" ".join(r.choice([f"w{i}" for i in range(40)], k)) for k in (50, 120)]
    line = " ".join(f"v{i}" for i in range(70))
    return some + [f"{line}\n{line} end", f"{line} x {line} y {line}", " ".join(["a b"] * 60)]


SCHEMA = "doc_id long, text string, n_words int, row string"


def test_brute_force(spark):
    rows = [(i, t, 1, "r") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[3:9], SCHEMA)
    out = R.repetition(df, ["doc_id", "n_words", "row"], least=5)
    got = out.orderBy("doc_id").collect()
    assert len(got) == len(rows) + 6 and out.columns[:3] == ["doc_id", "row", "n_words"]
    for r in got:
        want = plain(rows[r["doc_id"]][1], 5)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["longest_repeat"], r["covered_words"], [tuple(s) for s in r["repeats"]]) == want, rows[r["doc_id"]]
    assert R.repetition(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("least", [3, 4, 8])
def test_texts_lie_together(least):
    """Texts of one chunk do not see each other's words."""
    some = [t for t in texts() if t] * 2
    data, at = np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in some]])
    columns, row, start, end = R.measured(data, at, least)
    for k, t in enumerate(some):
        assert (*[int(c[k]) for c in columns], [(int(a), int(b)) for a, b in zip(start[row == k], end[row == k])]) == plain(t, least)


def test_very_long_texts(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    once = " ".join(words[i] for i in r.integers(0, 5000, 150_000))
    rows = [(0, "a " * 400_000, 1, ""), (1, once + " " + once, 1, ""), (2, once, 1, "")]
    got = {x["doc_id"]: x for x in R.repetition(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert (got[0]["longest_repeat"], got[0]["covered_words"]) == (399_999, 400_000)
    assert got[1]["longest_repeat"] >= 150_000 and got[1]["covered_words"] == 300_000
    assert got[2]["longest_repeat"] < 16 and got[2]["covered_words"] == 0 and got[2]["n_words"] == 150_000


def test_verdict(spark):
    fine = " ".join(f"w{i}" for i in range(400))
    twice = " ".join(f"t{i}" for i in range(120))
    rows = [(0, fine, 0, ""), (1, "too short", 0, ""), (2, "spam and eggs " * 40, 0, ""), (3, f"{fine} {twice} {fine[::-1]} {twice}", 0, ""), (4, None, 0, ""), (5, f"{fine} w1 w2 w3 w4 w5 w6 w7 w8 w9", 0, "")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.verdict(R.repetition(spark.createDataFrame(rows, SCHEMA), ["doc_id"])).select("doc_id", "base_failed", "kept").collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, True)}


def test_keeps_prose(spark):
    """Of labelled documents of good quality that the base rule passes, nearly all stay."""
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    out = R.op13_quality_repetition(spark, sf).join(good, "doc_id").where("not base_failed")
    n, kept = out.agg(F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    assert n > 50 and kept >= 0.98 * n
