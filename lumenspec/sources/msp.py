"""MSP libraries: files cut into blocks that many tasks read, records put together over block borders, energies carried on.

A record ends at a line of less than three characters. Spark's text scan cuts files at any size and at line ends (LF, CR LF
or CR), so a block may begin and end inside a record. A task hands over whole records, and the lines before its first and
after its last record end as fragments, of which a block has two at most; fragments meet in a small table. The energy
that a comment sets holds for all later records of the file: a task carries it within its block, and what it held at a
block's end is carried on from block to block in the table of fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspec.tables import written

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
ENERGY = re.compile(r"Comment: Energy\s*(\d+)")
START, PEAKS_END = re.compile(r"(?i)(name|id):"), re.compile(r"(?i)\s*[-+.\d]|num peaks:")
HEAD, WHOLE, TAIL = 0, 1, 2
SPLIT = "file string, block long, seq long, kind int, value string, energy int, last int"


def _record(file: str, block: int, seq: int, kind: int, lines: list[str], energy: int | None) -> tuple[tuple, int | None]:
    """The row of these lines, with the energy at their "Num Peaks" line, and the energy after them."""
    own, now = energy, energy
    for line in lines:
        if found := ENERGY.match(line):
            now = int(found[1])
        elif line[:10].lower() == "num peaks:":
            own = now
    return (file, block, seq, kind, "\n".join(lines) if lines else None, own, now), now


def _cut(batches: Iterator[pa.RecordBatch], end: str | None = None) -> Iterator[pa.RecordBatch]:
    """Of lines (value, file, block), in order: records and fragments as SPLIT has them. A record ends at a line `end`, or,
    without one, at a line of less than three characters and where a name or id follows its peaks."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in SPLIT.split(", ")]
    at, seq, kind, lines, energy, done = None, 0, HEAD, [], None, []

    def rows(close: bool) -> pa.RecordBatch:
        if close and at is not None:
            done.append(_record(*at, seq, TAIL if kind == WHOLE else HEAD, lines, energy)[0])
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names)
        done.clear()
        return out

    for b in batches:
        for value, *here in zip(*(b.column(i).to_pylist() for i in range(3))):
            if here != at:
                yield rows(True)
                at, seq, kind, lines, energy = here, 0, HEAD, [], None
            new = end is None and lines and START.match(value) and PEAKS_END.match(lines[-1])
            if not new and (len(value) >= 3 if end is None else value.rstrip() != end):
                lines.append(value)
                continue
            if lines or kind == HEAD:
                row, energy = _record(*at, seq, kind, lines, energy)
                done.append(row)
            seq, kind, lines = seq + 1, WHOLE, [value] if new else []
        yield rows(False)
    yield rows(True)


def split_records(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """(file, block, seq, value, energy): every record's text and the energy that holds for it; file, block, seq is their order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = written(lines.mapInArrow(lambda b: _cut(b, end), SPLIT))
    parts = rows.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tails = F.sum((F.col("kind") == TAIL).cast("int")).over(order)
    carried = F.last("last", ignorenulls=True).over(before)
    parts = written(parts.withColumn("group", tails).withColumn("carry", carried))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", "value", "energy", "last", "carry")))
    joined = parts.groupBy("file", "group").agg(pieces.alias("p"))
    text = F.array_join(F.filter(F.transform("p", lambda x: x["value"]), lambda x: x.isNotNull()), "\n")
    header = F.regexp_replace("value", r"(?is)\nnum peaks:.*", "")
    own = F.nullif(F.regexp_extract(header, r"(?s)(?:.*\n)?Comment: Energy\s*(\d+)", 1), F.lit("")).cast("int")
    text = F.array(text) if end else F.split(text, r"(?<=\n[-+.\d][^\n]{0,400})\n(?=(?i:name|id):)")  # a name after peaks, where a border hid one from the other
    joined = joined.select("file", "p", F.explode(text).alias("value"))
    stitched = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), "value", F.coalesce(own, F.col("p")[0]["energy"], F.col("p")[0]["carry"]).alias("energy")).where("value <> ''")
    carry = parts.where(F.col("kind") == HEAD).select("file", "block", "carry")
    whole = rows.where(F.col("kind") == WHOLE).join(carry, ["file", "block"], "left").select("file", "block", "seq", "value", F.coalesce("energy", "carry").alias("energy"))
    return stitched.unionByName(whole).withColumn("energy", F.coalesce("energy", F.lit(0)))


def field(name: str) -> Column:
    """The value of a key of a record, in any case; null if it is empty or absent."""
    return F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^{name}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)), F.lit(""))


def peaks_of(body: Column, most: Column | None = None, ordered: bool = True) -> Column:
    """The peaks of lines, sorted or as they stand: the first two numbers of each piece of a line between ; or :, so annotations are no peaks; of `most` pieces."""
    pieces = F.filter(F.split(body, "[\n;:]"), lambda x: F.rlike(x, F.lit(rf"^[ \t]*{NUMBER}[ \t,]+{NUMBER}(?![\w.])")))
    number = lambda x, k: F.regexp_extract(x, rf"^[ \t]*({NUMBER})[ \t,]+({NUMBER})", k).cast("double")
    some = F.slice(pieces, 1, most) if most is not None else pieces
    peaks = F.transform(some, lambda x: F.struct(number(x, 1).alias("mz"), number(x, 2).alias("intensity")))
    return F.array_sort(peaks) if ordered else peaks


def _params(header: Column) -> Column:
    """The keys (upper case) and values of a record's lines, split at the first colon; of a repeated key the last."""
    lines = F.filter(F.split(header, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = lambda a: F.filter(a, lambda x, i: F.size(F.filter(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"])) == 0)
    return F.map_from_entries(F.transform(F.array(pairs), last)[0])


def read_msp(spark: SparkSession, path: str, strict: bool = False, ordered: bool = True) -> DataFrame:
    """name, id, energy, mw, fp, num_peaks, peaks, params of each record of a file or folder.

    Keys have any case; id is ID, else the name, null without both. The peaks are those of the first num_peaks pairs after
    "Num Peaks", one or several to a line (with ;), up to a line that names another record; what follows a pair is an
    annotation; they come sorted, or as they stand with ordered=False. energy is that of the record's or the last earlier "Comment: Energy<n>" of its file, 0 before any.
    params has all keys of the record but the peaks. A record without "Num Peaks" has num_peaks null and no peaks.
    strict: a header line with more than one colon is an error.
    """
    rows = split_records(spark, path)
    body = F.regexp_replace(F.regexp_extract("value", r"(?is)(?:^|\n)num peaks[ \t]*:[^\n]*\n(.*)$", 1), r"(?s)(?:^|\n)(?:ID|Name):.*", "")
    header = F.regexp_extract("value", r"(?is)^(.*?)(?:(?:^|\n)num peaks[ \t]*:.*)?$", 1)
    n = F.nullif(F.regexp_extract("value", r"(?im)^num peaks[ \t]*:[ \t]*(\d+)", 1), F.lit("")).cast("int")
    if strict:
        odd = F.exists(F.split(header, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit(""))) > 1)
        rows = rows.withColumn("value", F.when(odd, F.raise_error(F.lit("a line has more than one colon"))).otherwise(F.col("value")))
    return rows.select(field("name").alias("name"), F.coalesce(field("id"), field("name")).alias("id"), "energy", field("mw").cast("double").alias("mw"), field("fp").alias("fp"), n.alias("num_peaks"), peaks_of(body, F.coalesce(n, F.lit(0)), ordered).alias("peaks"), _params(header).alias("params"))


def write_msp(library: DataFrame, path: str) -> None:
    """Records with the keys in the order Name, ID, FP, MW, Comment, Num Peaks (K2, K5), by id and energy (K4). Where the
    library has a column `notes` (an array as long as peaks), each peak's note follows it in quotes."""
    line = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{key}: "), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    number = lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))
    if "notes" in library.columns:
        peaks = F.zip_with("peaks", "notes", lambda p, a: F.when(a.isNull(), number(p)).otherwise(F.concat(number(p), F.lit(' "'), a, F.lit('"'))))
    else:
        peaks = F.transform("peaks", number)
    head = F.concat(line("Name", "name"), line("ID", "id"), line("FP", "fp"), line("MW", "mw"), F.concat(F.lit("Comment: Energy"), F.col("energy").cast("string"), F.lit("\n")))
    library.orderBy("id", "energy").select(F.concat(head, F.lit("Num Peaks: "), F.size("peaks").cast("string"), F.lit("\n"), F.array_join(peaks, "\n")).alias("value")).write.option("lineSep", "\n\n").text(path)


def dense_spectra(library: DataFrame, bins: int = 2000) -> DataFrame:
    """(id, structure, vec) of records (name, id, params, peaks as they stand): the intensity at each integer m/z, the last of
    equal ones, not normalised; the structure is the SMILES key, else the name (S6).

    m/z is cut to an integer; peaks at `bins` and beyond, or below 0, have no place. A record without peaks has zeros.
    """
    once = lambda value, use: F.transform(F.array(value), use)[0]
    at = F.transform("peaks", lambda p, i: F.struct(F.floor(p["mz"]).cast("int").alias("k"), i.alias("i"), p["intensity"].alias("v")))
    some = F.array_sort(F.filter(at, lambda x: x["k"].between(0, bins - 1)))
    last = lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["k"] != x["k"]))
    values = once(some, lambda a: F.map_from_entries(F.transform(last(a), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))))
    vec = once(values, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(m[k], F.lit(0.0))))
    return library.select("id", F.coalesce(F.col("params")["SMILES"], F.col("name")).alias("structure"), vec.alias("vec"))
