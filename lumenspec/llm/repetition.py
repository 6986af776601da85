"""Quality rules on repetition: what a text says again, from a suffix array of its words.

Texts of about CHUNK bytes are worked on together. Words are numbered text by text, so no two texts share a number and
one suffix array serves all: suffixes that share a prefix lie in one text. Only suffixes whose first three words stand
twice are sorted, by doubling; the others can't lie in an interval of a common prefix of three words. The common prefix
of neighbours is counted word by word only where the words before them differ, and is one less than the one before it
elsewhere, so all of them take O(n log n) steps and memory in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, span_hashes, text_buffers, with_columns, word_spans

WINDOW = 3  # words of a window of the base rule, and the least common prefix that is looked at
LEAST_REPEAT = 16  # words of the shortest repeat whose span counts as covered, above a line said twice
MOST_COVERED = 30  # percent of a text's words that such spans may cover
LONGEST_REPEAT = 100  # words of the longest repeat that a text may hold
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_words long, repeats array<struct<start:int,end:int>>"


def dense(*keys: np.ndarray) -> np.ndarray:
    """The place of each tuple of keys (the first counts most) among the distinct ones."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, how many of its lines with a word equal an earlier line."""
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([at[:-1], cuts + 1])), np.sort(np.concatenate([cuts, at[1:]]))
    n = np.searchsorted(cuts, at[1:]) - np.searchsorted(cuts, at[:-1]) + 1
    row = np.repeat(np.arange(len(at) - 1), n)
    words = np.concatenate([[0], np.cumsum(~SPACE[data])])
    some = words[ends] > words[starts]
    row, line = row[some], span_hashes(data, starts[some], ends[some])
    order = np.lexsort((line, row))
    row, line = row[order], line[order]
    again = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
    return np.bincount(row[1:][again], minlength=len(at) - 1)


def sorted_suffixes(rank: np.ndarray, some: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """The suffixes `some` in order. rank: the place of every suffix's first `width` words, equal if they are equal, and distinct outside `some`."""
    rank, active = rank.copy(), some
    while len(active):
        after = active + width
        inside = after < len(rank)
        inside[inside] = row[after[inside]] == row[active[inside]]
        follow = np.full(len(active), -1, np.int64)
        follow[inside] = rank[after[inside]]
        order = np.lexsort((follow, rank[active]))
        active, follow = active[order], follow[order]
        own, at = rank[active], np.arange(len(active))
        old = np.ones(len(active), bool)
        old[1:] = own[1:] != own[:-1]
        new = old.copy()
        new[1:] |= follow[1:] != follow[:-1]
        first = lambda mark: np.maximum.accumulate(np.where(mark, at, 0))
        rank[active] = own + first(new) - first(old)
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        width *= 2
    return some[np.argsort(rank[some])]


def common_prefixes(ids: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """For suffixes i and those before them in order, j, that share `width` words: how many words they share in all."""
    order = np.argsort(i)
    i, j = i[order], j[order]
    whole = np.append(ids, -1)  # also what lies before the first word
    head = (i == 0) | (j == 0) | (whole[i - 1] != whole[j - 1])
    out = np.zeros(len(i), np.int64)
    own = np.flatnonzero(head)
    shared, left = np.full(len(own), width, np.int64), np.arange(len(own))
    for _ in range(32):
        left = left[whole[i[own[left]] + shared[left]] == whole[j[own[left]] + shared[left]]]
        if not len(left):
            break
        shared[left] += 1
    for k in left:
        a, b, n, step = int(i[own[k]]), int(j[own[k]]), int(shared[k]), 64
        while True:
            x, y = whole[a + n : a + n + step], whole[b + n : b + n + step]
            m = min(len(x), len(y))
            off = np.flatnonzero(x[:m] != y[:m])
            if len(off):
                n += int(off[0])
                break
            n, step = n + m, step * 2
        shared[k] = n
    out[own] = shared
    source = np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
    out = out[source] - (i - i[source])
    back = np.empty(len(i), np.int64)
    back[order] = out
    return back


def measured(data: np.ndarray, at: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns of OUT but the last, and the spans (text, start, end, in words) of repeats of `least` words and more."""
    texts = len(at) - 1
    starts, ends, row = word_spans(data, at)
    n = np.bincount(row, minlength=texts)
    below = lambda mark: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(mark)]))
    chars, symbols = below(~SPACE[data] & ((data & 0xC0) != 0x80)), below(SYMBOLS[data])
    ids = dense(row, span_hashes(data, starts, ends))
    words = len(ids)
    follows = lambda k: np.where((np.arange(words) + k < words) & (np.append(row[k:], np.full(min(k, words), -1)) == row), np.append(ids[k:], np.full(min(k, words), -1)), -1)
    three = dense(ids, follows(1), follows(2))
    size = np.bincount(three, minlength=1)
    some = np.flatnonzero(size[three] > 1)
    covering = lambda s, e: np.cumsum(np.bincount(s, minlength=words + 1) - np.bincount(e, minlength=words + 1))[:words] > 0
    again = np.bincount(row[covering(some, some + WINDOW)], minlength=texts)
    longest = np.zeros(texts, np.int64)
    order = sorted_suffixes((np.cumsum(size) - size)[three], some, row, WINDOW)
    near = three[order][1:] == three[order][:-1]
    i, j = order[1:][near], order[:-1][near]
    shared = common_prefixes(ids, i, j, WINDOW)
    np.maximum.at(longest, row[i], shared)
    far = shared >= least
    i, j, shared = i[far], j[far], shared[far]
    inside = covering(np.concatenate([i, j]), np.concatenate([i, j]) + np.concatenate([shared, shared]))
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    opens = inside & (np.append(True, row[1:] != row[:-1])[:words] | (edge[:-1] == 1))
    closes = inside & (np.append(row[1:] != row[:-1], True)[-words:] | (edge[1:] == -1)) if words else inside
    first = np.concatenate([[0], np.cumsum(n)])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return [n, chars, symbols, repeated_lines(data, at), again, longest, np.bincount(row[inside], minlength=texts)], row[a], a - first[row[a]], b - first[row[a]]


def repetition(df: DataFrame, keep: list[str], text: str = "text", least: int = LEAST_REPEAT) -> DataFrame:
    """The columns `keep` of `df`, and of each whole text, in words [^\\x20\\x09-\\x0D]+:

    n_words; word_chars, the code points in words; n_symbols, characters #*$%&|<>; n_dup_lines, lines with a word that equal
    an earlier line; n_repeat_words, words in windows of three that stand twice or more; longest_repeat, the words of the
    longest substring that stands twice (0 below three; occurrences may overlap); covered_words, words in maximal
    repeated substrings of `least` words and more, whose united spans are `repeats` (start and end in words). A suffix's
    longest interval is the longer common prefix with its two neighbours in order, so their spans unite to those of all
    intervals. A null text has no words and zeros; repeated rows are rows of their own; an empty table gives an empty
    table; columns of `keep` named like the new ones give way.
    """
    new = [c.split()[0] for c in OUT.split(", ")]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c not in new]).alias("row")
    rows = df.select(kept, F.col(f"`{text}`").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                columns, row, start, end = measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, pa.int64()) for c in columns], lists], ["row", *new])

    return rows.mapInArrow(measure, with_columns(rows.select("row").schema, OUT)).select("row.*", *new)


def verdict(measures: DataFrame, most_covered: float = MOST_COVERED, longest: int = LONGEST_REPEAT) -> DataFrame:
    """`measures` with base_failed (under 50 words, or over half of the words in repeated windows) and kept: not failed,
    at most most_covered percent of the words in long repeats, and none of more than `longest` words."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return measures.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op13_quality_repetition(spark, sf_dir: str) -> DataFrame:
    out = verdict(repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STEPS = [1, 2, WINDOW, 6, 12, LEAST_REPEAT, 32, 64, LONGEST_REPEAT + 1]  # lengths of windows, each of two of the one before
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
w1 AS (SELECT id, i, dense_rank() OVER (ORDER BY word) AS k FROM (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d)),
""" + ",\n".join(f"w{m} AS (SELECT id, i, dense_rank() OVER (ORDER BY k, b) AS k FROM (SELECT id, i, k, lead(k, {m - less}) OVER (PARTITION BY id ORDER BY i) AS b FROM w{less}) WHERE b IS NOT NULL)" for less, m in zip(_STEPS, _STEPS[1:])) + ",\n" + ",\n".join(f"c{m} AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(range(i, i + {m})) FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) > 1 AS twice FROM w{m}) WHERE twice) GROUP BY id)" for m in (WINDOW, LEAST_REPEAT, LONGEST_REPEAT + 1)) + rf""",
l AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(l.n, 0) AS n_dup_lines, coalesce(c{WINDOW}.n, 0) AS n_repeat_words, coalesce(c{LEAST_REPEAT}.n, 0) AS covered, c{LONGEST_REPEAT + 1}.n IS NOT NULL AS long
      FROM d LEFT JOIN l USING (id) LEFT JOIN c{WINDOW} USING (id) LEFT JOIN c{LEAST_REPEAT} USING (id) LEFT JOIN c{LONGEST_REPEAT + 1} USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered <= {MOST_COVERED} * n_words AND NOT long AS kept FROM m
"""
