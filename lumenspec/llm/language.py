"""Language identification by Bayesian evidence fusion.

A row's posterior over languages (and "und", no language) multiplies four pieces of evidence:

* the text: likelihood of its byte trigrams under smoothed models, fitted on a bounded sample of labelled rows (SAMPLE a
  language, SAMPLE_CHARS characters each). Trigrams of a text depend on each other, so they count as EVIDENCE at most;
* the declared markup language: how often it is declared where the text says a language, learnt from all rows;
* the address suffix, in the same way;
* a prior for the host, leaving the row itself out, smoothed towards its domain's, and that towards the corpus's.

The last three come from sums of the text's posteriors over all rows, grouped by host, domain, suffix and declaration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_table, chunks, text_buffers, with_columns

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
ROWS = 1 << 15
SAMPLE, SAMPLE_CHARS, EVIDENCE, WEIGHT = 300, 4000, 64, 8.0
SMALL = 20_000  # rows of a table of priors up to which it is broadcast; beyond, Spark joins it by shuffles, with the same result
MOST_HASH = (1 << 63) - 1

_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[97:123] = _LETTER[65:91] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, text) of the trigrams around a letter; what is no letter counts as a space, as do the text's edges."""
    letter = _LETTER[data]
    x = np.where(letter, LOWER[data], 32).astype(np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[edge[:-1]], after[edge[1:]] = 32, 32
    at = np.flatnonzero(letter)
    h = (before[at] << np.uint32(16) | x[at] << np.uint32(8) | after[at]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def fit(texts: dict[str, list[str]]) -> np.ndarray:
    """Log probabilities [ROWS, languages + 1] of trigrams; the last is uniform."""
    out = np.full((ROWS, len(texts) + 1), -np.log(ROWS), np.float32)
    for k, rows in enumerate(texts.values()):
        data, offsets = text_buffers(pa.array(rows, pa.string()))
        counts = np.bincount(trigrams(data, offsets)[0], minlength=ROWS) + 0.5
        out[:, k] = np.log(counts / counts.sum())
    return out


def fit_on(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Fit on at most SAMPLE keys a language, the first by a hash of the key, of the first by order of a key's texts; a language
    without rows is like "und".

    The keys of each language are counted first; texts are read only below the hash that, by this count, holds twice
    the sample (and below four times that again, should a count be far off), in one pass for all languages.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(language).alias("l"), F.xxhash64(key).alias("h")).where(F.col("l").isin(*languages) & (F.length("t") > 0))
    keys = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = {k: 2 * SAMPLE / n for k, n in keys.items() if n}
    found: dict[str, list[str]] = {k: [] for k in languages}
    while share:
        below = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(MOST_HASH, int((2 * x - 1) * MOST_HASH)))) for k, x in share.items()])
        some = rows.where(F.col("h") <= below).groupBy("l", "h").agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t")).collect()
        for k in list(share):
            found[k] = [t for _, t in sorted((r["h"], r["t"]) for r in some if r["l"] == k)][:SAMPLE]
            if len(found[k]) == SAMPLE or share[k] >= 1:
                del share[k]
        share = {k: 4 * x for k, x in share.items()}
    return fit(found)


def with_likelihoods(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "_ll") -> DataFrame:
    """A column more: log likelihoods of the whole text under each language and "und" (null where it has no letter).
    `text` is a column, or "column.field" of a struct."""
    outer, _, inner = text.partition(".")
    place, shared = df.columns.index(outer), df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offsets = text_buffers(b.column(place).field(inner) if inner else b.column(place))
            ll, n = np.zeros((b.num_rows, m.shape[1])), np.zeros(b.num_rows, np.int64)
            for s, e in chunks(offsets):
                gram, row = trigrams(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
                if len(row):
                    some, first = np.unique(row, return_index=True)
                    ll[s + some] = np.add.reduceat(m[gram], first, axis=0, dtype=np.float64)
                    n[s:e] = np.bincount(row, minlength=e - s)
            ll *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * m.shape[1]), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.compute.if_else(pa.array(n > 0), flat, pa.scalar(None, flat.type))], [*b.schema.names, out])

    return df.mapInArrow(score, with_columns(df.schema, f"`{out}` array<double>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _posterior(ll: Column) -> Column:
    e = _once(F.array_max(ll), lambda top: F.transform(ll, lambda x: F.exp(x - top)))
    return _once(e, lambda e: _once(_total(e), lambda total: F.transform(e, lambda x: x / total)))


def _sums(rows: DataFrame, keys: Sequence[str], n: int, name: str) -> DataFrame:
    """Per group an array: the sums of the text's posteriors."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("_p")[k]) for k in range(n)]).alias(name))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _smooth(sums: Column, towards: Column) -> Column:
    return _once(_total(sums), lambda total: F.zip_with(sums, towards, lambda s, t: (s + WEIGHT * t) / (total + WEIGHT)))


def priors(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """From (_ll, host, domain, suffix, declared) of all rows: per address its sums, its domain's prior and its suffix's evidence; per declaration its evidence."""
    rows = rows.where("_ll is not null").withColumn("_p", _posterior(F.col("_ll")))
    hosts = as_table(_sums(rows, ["host", "domain", "suffix"], n, "sums"))
    add = lambda d, keys, name: d.groupBy(*keys).agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(n)]).alias(name))
    whole = add(hosts, [], "whole")
    ones = F.array(*[F.lit(1.0 / n)] * n)
    whole = whole.select(F.when(F.col("whole")[0].isNull(), F.transform(ones, lambda x: x * 0)).otherwise(F.col("whole")).alias("whole")).withColumn("corpus", _smooth(F.col("whole"), ones))
    seen = lambda sums: F.zip_with(sums, F.col("whole"), lambda s, w: F.log((s + WEIGHT * _total(sums) / F.greatest(_total(F.col("whole")), F.lit(1.0))) / (w + WEIGHT)))
    domains = add(hosts, ["domain"], "domain_sums").crossJoin(F.broadcast(whole)).select("domain", _smooth(F.col("domain_sums"), F.col("corpus")).alias("domain_prior"))  # one row
    suffixes = add(hosts, ["suffix"], "suffix_sums").crossJoin(F.broadcast(whole)).select("suffix", seen(F.col("suffix_sums")).alias("suffix_log"))
    declared = _sums(rows, ["declared"], n, "d").crossJoin(F.broadcast(whole)).select("declared", seen(F.col("d")).alias("declared_log"))
    return as_table(hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "domain", "suffix", "sums", "domain_prior", "suffix_log")), as_table(declared)


def fuse(rows: DataFrame, addresses: DataFrame, declared: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows with language (the most probable, ties to the first; "und" where the text has no letter) and probability."""
    small = lambda d: F.broadcast(d) if d.limit(SMALL + 1).count() <= SMALL else d
    joined = rows.join(small(addresses), ["host", "domain", "suffix"], "left").join(small(declared), "declared", "left")
    rest = _once(_posterior(F.col("_ll")), lambda p: F.zip_with("sums", p, lambda s, own: F.greatest(s - own, F.lit(0.0))))
    prior = _once(rest, lambda sums: _smooth(sums, F.col("domain_prior")))
    log = F.zip_with("_ll", prior, lambda x, y: x + F.log(y))
    for more in ("suffix_log", "declared_log"):
        log = F.zip_with(log, more, lambda x, y: x + y)
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    best = lambda log: F.element_at(names, F.array_position(log, F.array_max(log)).cast("int"))
    answer = _once(log, lambda log: F.struct(best(log).alias("language"), F.array_max(_posterior(log)).alias("probability")))
    known = F.col("_ll").isNotNull()
    joined = joined.withColumn("_answer", F.when(known, answer))
    joined = joined.withColumn("language", F.when(known, F.col("_answer.language")).otherwise(UNKNOWN)).withColumn("probability", F.when(known, F.col("_answer.probability")).otherwise(1.0))
    return joined.drop("_answer", "_ll", *[c for c in addresses.columns if c not in ("host", "domain", "suffix")], "declared_log")


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last label) of an address; empty where there is none."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _without(html: Column, close: str, opening: str) -> Column:
    """html without what lies between the first `opening` and a `close` (patterns): cut at every `close`, so a page is read
    once, whatever it leaves open. What is never closed stays."""
    cut = lambda parts: F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.regexp_replace(x, f"(?is){opening}.*", " ")).otherwise(x))
    return F.array_join(_once(F.split(html, close), cut), " ")


def visible(html: Column) -> Column:
    """The text of a page, without scripts, styles, comments, tags and entities, in time proportional to its length."""
    for close, opening in (("(?i)</script>", "<script[^<>]*+>"), ("(?i)</style>", "<style[^<>]*+>"), ("-->", "<!--")):
        html = _without(html, close, opening)
    return F.regexp_replace(html, r"<[^<>]*+>|&#?\w++;", " ")


def declared_in(html: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(html, r"(?i)<html[^<>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def identify_pages(pages: DataFrame, model: np.ndarray, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page key, language, probability, declared, host of every page; whole pages count.

    Null or empty pages and such without letters are "und" with probability 1; a null url is the host ""; repeated rows
    are rows of their own; an empty table gives an empty table; other columns are ignored.
    """
    host, domain, suffix = address(F.col(url))
    rows = pages.select(F.col(key), visible(F.coalesce(F.col(html), F.lit(""))).alias("_text"), declared_in(F.col(html)).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    rows = as_table(with_likelihoods(rows, model, "_text").drop("_text"))
    return fuse(rows, *priors(rows, model.shape[1])).select(key, "language", "probability", "declared", "host")


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (text, lang as declared, source as host) whose text is in one of the languages, by the same fusion; the columns of `docs`.

    Null, empty and other texts without letters are "und" and go; a null lang or source is the empty one; repeated rows
    are rows of their own; an empty table gives an empty table; other columns pass through, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce("lang", F.lit("")).alias("declared"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))
    model = fit_on(docs)
    rows = as_table(with_likelihoods(rows, model, "_row.text"))
    return fuse(rows, *priors(rows, model.shape[1])).where(F.col("language") != UNKNOWN).select("_row.*")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    model = fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
