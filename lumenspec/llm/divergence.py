"""Source divergence audit: how far each source's words lie from another source's and from its language's.

Two passes over the texts. The first counts, exactly, in how many documents of its language each term stands. The second
runs an automaton of the kept terms, each padded with a delimiter on both sides, over the padded words of the texts and
counts their occurrences by source. A task gathers texts of about GATHER bytes, so that the automaton reads a word that
they repeat once, with its counts beside it. The terms of the most documents make up the automaton that is broadcast, of at most HEAD bytes;
words that it does not hold go on, as texts, to the parts of the rest, each with an automaton of its own. From there on
rows are sparse: pairs of sources differ from what absent terms give only where a term occurs.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

SCALE = 1_000_000_000
HEAD = 8 << 20  # bytes of terms in one automaton, which takes about ten times as much in each Python worker
LONGEST = 64  # bytes of a term in the broadcast automaton
FLUSH = 1 << 19  # counts that a task holds
GATHER = 1 << 22  # bytes of texts whose words are counted before the automaton reads them
WORDS = 1 << 21  # bytes of words for the parts of the rest that a task holds
PAIRS = 1 << 20  # pairs that a task holds
#: Letters are A-Z, a-z and all beyond ASCII; every other byte delimits. A-Z become lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents (lang, text) of its language a term stands."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([w.decode() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "term", "docs"])
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                seen.setdefault(lang, Counter()).update(set(words_of(text.as_py())))
                if sum(map(len, seen.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(part, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Of the terms between delimiters; a match's value is the term's place."""
    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(f" {t} ", k)
    a.make_automaton()
    return a


_built: dict[str, dict[str, tuple[np.ndarray, ahocorasick.Automaton, list[bytes]]]] = {}


def _automata(key: str, shared) -> dict[str, tuple[np.ndarray, ahocorasick.Automaton, list[bytes]]]:
    """By language, the numbers of the terms, their automaton and the terms; a worker keeps those of its last tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = {lang: (ids, automaton(terms), [t.encode() for t in terms]) for lang, (ids, terms) in shared.value.items()}
    return _built[key]


def recount(texts: DataFrame, kept: DataFrame, rest: int = 0) -> DataFrame:
    """(g, t, n, lang, part, words): occurrences n in texts (g, lang, text) of the kept terms (t, lang, term), which fit one automaton.

    With `rest` above 0, words that are not kept come as rows too: t and n are null, part (0 to rest - 1) is where a word
    belongs, and `words` has such words with delimiters between them, repeated as they stand. For other rows these are null.
    """
    table = kept.select("lang", "t", "term").toArrow()
    langs, ids, terms = table["lang"].to_pylist(), table["t"].to_numpy(), table["term"].to_pylist()
    places: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        places.setdefault(lang, []).append(k)
    shared = texts.sparkSession.sparkContext.broadcast({lang: (ids[k], [terms[i] for i in k]) for lang, k in places.items()})
    key = uuid.uuid4().hex
    kinds = {"g": pa.int64(), "t": pa.int64(), "n": pa.int64(), "lang": pa.string(), "part": pa.int32(), "words": pa.string()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(key, shared)
        fresh: dict[tuple[int, str], Counter] = {}  # words that no automaton has read yet
        seen: dict[tuple[int, str], list[np.ndarray]] = {}  # places of terms, and how often each was found
        others: dict[tuple[int, str, int], list[bytes]] = {}
        gathered = counts = held = 0

        def read() -> int:
            """Runs the automata over the distinct fresh words; gives back the bytes of words for the rest."""
            more = 0
            for lang in {lang for _, lang in fresh}:
                of_lang = {g: c for (g, x), c in fresh.items() if x == lang}
                place: dict[bytes, int] = {}
                if lang in automata:
                    _, found, terms = automata[lang]
                    padded = b" " + b" ".join(set().union(*of_lang.values())) + b" "
                    place = {terms[k]: k for _, k in found.iter(padded.decode())}
                for g, c in of_lang.items():
                    at = np.fromiter(map(place.get, c, itertools.repeat(-1)), np.int64, len(c))
                    both = np.stack([at, np.fromiter(c.values(), np.int64, len(c))])[:, at >= 0]
                    seen.setdefault((g, lang), []).append(both)
                    if rest:
                        for w, n in [(w, n) for w, n in c.items() if w not in place]:
                            others.setdefault((g, lang, zlib.crc32(w) * rest >> 32), []).extend([w] * n)
                            more += len(w) * n
            fresh.clear()
            return more

        def merged() -> int:
            """Adds up what was found of each term; gives back how many counts are held."""
            for k, parts in seen.items():
                at, n = np.concatenate(parts, axis=1)
                terms, where = np.unique(at, return_inverse=True)
                seen[k] = [np.stack([terms, np.bincount(where, n, len(terms)).astype(np.int64)])]
            return sum(x[0].shape[1] for x in seen.values())

        def flush() -> Iterator[pa.RecordBatch]:
            for (g, lang), [(at, n)] in seen.items():
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(automata[lang][0][at]), pa.array(n), *[pa.nulls(len(at), kinds[k]) for k in ("lang", "part", "words")]], list(kinds))
            if others:
                rows = [(g, None, None, lang, part, b" ".join(w).decode()) for (g, lang, part), w in others.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))
            seen.clear()
            others.clear()

        for b in batches:
            for g, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())):
                fresh.setdefault((g, lang), Counter()).update(words_of(data := text.as_py()))
                gathered += len(data or b"")
                if gathered > GATHER:
                    held += read()
                    gathered = 0
                    counts = sum(x.shape[1] for parts in seen.values() for x in parts)
                    if counts > FLUSH:
                        counts = merged()
                    if held > WORDS or counts > FLUSH // 2:
                        merged()
                        yield from flush()
                        held = 0
        read()
        merged()
        yield from flush()

    return texts.select("g", "lang", "text").mapInArrow(scan, "g long, t long, n long, lang string, part int, words string")


def occurrences(docs: DataFrame, kept: DataFrame, head_bytes: int = HEAD, longest: int = LONGEST) -> DataFrame:
    """(g, t, n): how often each kept term (t, lang, term, docs) occurs in the documents (g, lang, text); n > 0.

    The terms of the most documents, up to head_bytes, are broadcast; a term longer than `longest` bytes is not among
    them. Where terms are left, words that the first automaton does not hold are written by parts of the rest, each small
    enough for an automaton, and every part's words meet their own terms.
    """
    size = F.octet_length("term") + 2
    short = F.octet_length("term") <= longest
    level = F.floor(F.log2(F.col("docs").cast("double"))).cast("int")
    by_level = sorted(kept.groupBy(F.when(short, level).otherwise(-1).alias("level")).agg(F.sum(size)).collect(), reverse=True)
    least, held, left = 64, 0, 0
    for k, n in by_level:
        if k >= 0 and not left and held + n <= head_bytes:
            least, held = k, held + n
        else:
            left += n
    in_head = short & (level >= least)
    parts = -(-2 * left // head_bytes)  # twice as many, as hashed parts differ in size
    found = recount(docs, kept.where(in_head), parts)
    if parts:
        first = as_table(found)
        part = F.shiftright(F.crc32(F.col("term").cast("binary")) * parts, 32).cast("int")
        tail = as_table(kept.where(~in_head).withColumn("part", part))
        rest = as_table(first.where("t is null").select("g", "lang", F.col("words").alias("text"), "part"))
        own = [as_table(recount(rest.where(F.col("part") == k), tail.where(F.col("part") == k))) for k in range(parts)]
        found = functools.reduce(DataFrame.unionByName, own, first.where("t is not null"))
    return found.groupBy("g", "t").agg(F.sum("n").alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact: a long division by three digits a step, so nothing overflows below 9 * 10^15."""
    left, quotient = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        quotient, left = quotient * 1000 + _div(left, total), left % total
    return quotient + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of positive integers up to 10^9 + 1."""
    d = p - q
    return d * d // q


def _without_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, i, own, other: lists of (p, terms), z, y: what absent terms have, rest): (g, i, value) as if no term were in both."""
    for b in batches:
        values = []
        for own, other, z, y, rest in zip(*(b.column(c) for c in range(2, 7))):
            z, y = np.int64(z.as_py()), np.int64(y.as_py())
            (p, h), (q, k) = (([x.field(j).to_numpy() for j in (0, 1)] if (x := side.values) is not None else [np.zeros(0, np.int64)] * 2) for side in (own, other))
            values.append(int((h * gap(p, y)).sum() + (k * gap(z, q)).sum() + rest.as_py() * gap(z, y)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.int64())], ["g", "i", "value"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows `own`, a term's list of (g, p, z): (g, i, value) by how much terms that both have differ from that, summed over some of them."""
    for b in batches:
        ends = b.column(0).offsets.to_numpy()
        g, p, z = (b.column(0).values.field(k).to_numpy() for k in range(3))
        n = np.diff(ends)
        first, size = np.repeat(ends[:-1], n), np.repeat(n, n)  # of each entry, its list
        a, done = 0, np.concatenate([[0], np.cumsum(size)])
        names, g = np.unique(g[ends[0] : ends[-1]], return_inverse=True)
        p, z, first, many = p[ends[0] : ends[-1]], z[ends[0] : ends[-1]], first - ends[0], len(names)
        while a < len(first):
            e = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(a, e), size[a:e])
            y = np.arange(len(x)) - np.repeat(done[a:e] - done[a], size[a:e]) + first[x]
            some = g[x] != g[y]
            x, y = x[some], y[some]
            value = gap(p[x], p[y]) - gap(p[x], z[y]) - gap(z[x], p[y]) + gap(z[x], z[y])
            pair, where = np.unique(g[x] * many + g[y], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, where, value)
            yield pa.RecordBatch.from_arrays([pa.array(names[pair // many]), pa.array(names[pair % many]), pa.array(total)], ["g", "i", "value"])
            a = e


def divergence(df: DataFrame, least_docs: int = 3, most_terms: int = 200, head_bytes: int = HEAD, longest: int = LONGEST) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text), all integers exact.

    A language keeps the V terms that stand in at least least_docs of its documents. With N occurrences of kept terms, a
    source, or a whole language, gives a kept term with `count` of them p = 1 + floor(10^9 (count + 1) / (N + V)). Part
    `pair` has for each source (of a language) every other one, with the sum over all kept terms of floor((p - q)^2 / q),
    q the other's. Part `term` has the most_terms kept terms whose p is farthest above the language's q, by that term's
    value. Ranks go by falling value, then by item (bytewise). Null text, lang and source are ''; a source without terms
    has pairs like others; V = 0 gives pairs of value 0 and no terms; repeated rows count each; an empty table gives an
    empty table; other columns are ignored.
    """
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("g", F.xxhash64("lang", "source"))
    kept = as_table(document_frequencies(docs).where(F.col("docs") >= least_docs).withColumn("t", F.monotonically_increasing_id()))
    counts = as_table(occurrences(docs, kept, head_bytes, longest))
    groups = docs.select("lang", "source", "g").distinct().join(counts.groupBy("g").agg(F.sum("n").alias("n")), "g", "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "g", zero("v").alias("v"), F.greatest(zero("n") + zero("v"), F.lit(1)).alias("total"), F.greatest(F.sum(zero("n")).over(of_lang) + zero("v"), F.lit(1)).alias("lang_total"))
    groups = as_table(groups.withColumn("z", _share(F.lit(0).cast("long"), F.col("total"))))
    if groups.groupBy("g").count().where("count > 1").take(1):
        raise RuntimeError("two sources share a hash")
    rows = as_table(counts.join(groups.select("g", "total", "lang_total", "z"), "g").select("g", "t", "n", "lang_total", "z", _share(F.col("n"), F.col("total")).alias("p")))

    q = _share(F.sum("n").over(Window.partitionBy("t")), F.col("lang_total"))
    above = rows.withColumn("q", q).where("p > q").select("g", "t", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    named = groups.select("lang", "source", "g")
    terms = above.join(kept.select("t", F.col("term").alias("item")), "t").join(named, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= most_terms)

    alike = rows.groupBy("g", "p").agg(F.count("*").alias("h")).groupBy("g").agg(F.collect_list(F.struct("p", "h")).alias("own"), F.sum("h").alias("terms"))
    profile = as_table(groups.join(alike, "g", "left").select("lang", "g", "z", "v", "own", zero("terms").alias("terms")))
    other = profile.select("lang", F.col("g").alias("i"), F.col("z").alias("y"), F.col("own").alias("other"), F.col("terms").alias("more"))
    met = profile.join(other, "lang").where("g <> i").select("g", "i", "own", "other", "z", "y", (F.col("v") - F.col("terms") - F.col("more")).alias("rest"))
    lists = rows.groupBy("t").agg(F.collect_list(F.struct("g", "p", "z")).alias("own")).where(F.size("own") > 1).select("own")
    parts = met.mapInArrow(_without_common, "g long, i long, value long").unionByName(lists.mapInArrow(_common, "g long, i long, value long"))
    sums = parts.groupBy("g", "i").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = sums.join(named, "g").join(named.select(F.col("g").alias("i"), F.col("source").alias("item")), "i")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return terms.unionByName(pairs)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS p FROM f WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM f GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""
