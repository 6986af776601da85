"""Files of model parameters: feature names, energies and weights, dense or sparse, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPARSE = "SPARSE"  # the first line of a sparse file, a fixed value
FEW = 0.25  # share of weights that are not 0 below which a file is sparse


def parameter_lines(weights: DataFrame, features: list[str], energies: int, size: int, sparse_row: int = 20, dense_row: int = 50) -> DataFrame:
    """(line, text) of a file with `size` weights, of which `weights` (place from 0, weight) has those that may differ from 0.

    The header has the number of features, their names, the number of energies and that of the weights. If fewer than a
    quarter differ from 0, the file begins with SPARSE, the header ends with their number, and they follow with their
    places, sparse_row to a line; else all follow, dense_row to a line. Weights have eight significant digits. A place
    given twice, or outside 0 to size - 1, is an error.
    """
    found = weights.agg(F.count("*"), F.count_distinct("place"), F.coalesce(F.min("place"), F.lit(0)), F.coalesce(F.max("place"), F.lit(-1)), F.count_if(F.col("weight") != 0)).first()
    if found[0] != found[1] or found[2] < 0 or found[3] >= size:
        raise ValueError("weights have one place each, from 0 to size - 1")
    used = int(found[4])
    few = used < FEW * size
    head = [*([SPARSE] if few else []), str(len(features)), " ".join(features), str(energies), str(size), *([str(used)] if few else [])]
    spark = weights.sparkSession
    number = F.format_string("%.8g", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))
    if few:
        counts = weights.where("weight <> 0").select("place", F.concat_ws(" ", F.col("place").cast("string"), number).alias("t"), F.floor(F.col("place") / dense_row / 64).alias("part"))
        before = counts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = counts.join(before, "part").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1)
        width = sparse_row
    else:
        rows = spark.range(size).withColumnRenamed("id", "place").join(weights, "place", "left").select("place", number.alias("t"), F.col("place").alias("k"))
        width = dense_row
    lines = rows.groupBy(F.floor(F.col("k") / width).alias("row")).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("p"))
    body = lines.select((F.col("row") + len(head)).alias("line"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))
    return spark.createDataFrame(list(enumerate(head)), "line long, text string").unionByName(body)


def read_parameters(lines: DataFrame) -> DataFrame:
    """(features, energies, size, place, weight) of the lines (line, text) of a file, sparse or dense; weights that a sparse file leaves out have no row.

    The header, at most six lines, is read by the driver. A weight that is no number, or another number of weights than
    the header says, is an error.
    """
    head = [r["text"].strip() for r in lines.where("line < 6").orderBy("line").collect()]
    few = head[0] == SPARSE
    n, names, energies, size = head[few : few + 4]
    start = few + 4 + few
    expected = int(head[few + 4]) if few else int(size)
    body = lines.where(F.col("line") >= start).select("line", F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("t"))
    if len(names.split()) != int(n):
        raise ValueError(f"{n} features are named, {len(names.split())} found")
    if few:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda k: F.struct(F.get("t", 2 * k).cast("long").alias("place"), F.get("t", 2 * k + 1).cast("double").alias("weight")))
        rows = body.where(F.size("t") > 1).select(F.explode(pairs).alias("p")).select("p.*")
    else:
        before = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        at = body.groupBy("line").agg(F.sum(F.size("t")).alias("n")).select("line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))  # a count a line
        rows = body.join(at, "line").select("at", F.posexplode("t").alias("i", "w")).select((F.col("at") + F.col("i")).cast("long").alias("place"), F.col("w").cast("double").alias("weight"))
    if rows.count() != expected:
        raise ValueError(f"{expected} weights are announced, {rows.count()} found")
    return rows.select(F.array(*[F.lit(x) for x in names.split()]).alias("features"), F.lit(int(energies)).alias("energies"), F.lit(int(size)).alias("size"), "place", "weight")


def read_features(spark: SparkSession, path: str) -> list[str]:
    """The names of a feature list, a line each, up to the first line of at most one character; none is an error (S22). A list is read by the driver."""
    names: list[str] = []
    for r in spark.read.text(path, wholetext=True).collect():
        for line in r["value"].splitlines():
            if len(line.strip()) <= 1:
                break
            names.append(line.strip())
    if not names:
        raise ValueError(f"no features in {path}")
    return names
