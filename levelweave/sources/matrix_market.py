"""Matrix Market files: many files at once to entries, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelweave.sources.errors import EntriesError, FormatError, HeaderError
from levelweave.sources.triplets import parse_triplets

# Words of the banner.
FORMATS = ("coordinate", "array")
FIELDS = ("real", "integer", "double", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


def read_header(spark: SparkSession, path: str) -> dict[str, object]:
    """Banner and sizes of one file: format, field, symmetry, m, n, nnz. Only the head of the file is read."""
    lines = (r[0] for r in spark.read.text(path).limit(1000).toLocalIterator())
    banner = next(lines, "").strip().lower().split()
    if len(banner) != 5 or banner[:2] != ["%%matrixmarket", "matrix"]:
        raise HeaderError(path, "no banner '%%MatrixMarket matrix FORMAT FIELD SYMMETRY'")
    kind, field, symmetry = banner[2:]
    for word, known in ((kind, FORMATS), (field, FIELDS), (symmetry, SYMMETRIES)):
        if word not in known:
            raise HeaderError(path, f"unknown word {word!r}")
    size = next((x for x in lines if x.strip() and not x.startswith("%")), "").split()
    want = 3 if kind == "coordinate" else 2
    if len(size) != want or not all(x.isdigit() for x in size):
        raise HeaderError(path, f"the line of sizes needs {want} numbers")
    m, n = int(size[0]), int(size[1])
    return {"format": kind, "field": field, "symmetry": symmetry, "m": m, "n": n, "nnz": int(size[2]) if want == 3 else m * n}


def read_mtx(spark: SparkSession, path: str, graph_id: int, check: bool = True) -> DataFrame:
    """(graph_id, row, col, val), 0-based, of a coordinate file; pattern entries are 1.0, unsorted and empty columns are fine.

    Of a symmetric matrix the triangle in the file is read; ``algebra.full`` gives both. Skew-symmetric and hermitian files raise FormatError.

    ``check`` counts entries, and raises EntriesError if lines are broken or too few or many.
    """
    h = read_header(spark, path)
    if h["field"] == "complex":
        raise FormatError(path, "complex values")
    if h["format"] != "coordinate":
        raise FormatError(path, "an array file: use read_array")
    if h["symmetry"] not in ("general", "symmetric"):
        raise FormatError(path, f"{h['symmetry']} matrices")
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = f"{h['m']} {h['n']} {h['nnz']}"
    first = text.filter(F.regexp_replace(F.trim("value"), r"\s+", " ") == size).agg(F.min("at").alias("first"))
    lines = text.join(F.broadcast(first), F.col("at") > F.col("first")).select(F.col("at").alias("line_id"), F.lit(graph_id).cast("long").alias("graph_id"), F.lit(0).alias("line_no"), F.regexp_replace(F.trim("value"), r"\s+", ",").alias("line"))
    graphs = spark.createDataFrame([(graph_id, int(h["m"]), int(h["n"]), h["field"])], "graph_id long, m long, n long, field string")
    parsed = parse_triplets(lines, graphs, row_bound="m")
    if check:
        good, bad = parsed.agg(F.count(F.when(F.col("reason").isNull(), 1)), F.count("reason")).first()
        if bad or good != h["nnz"]:
            raise EntriesError(path, f"{good} good and {bad} broken entries; the header says {h['nnz']}")
    return parsed.filter("reason is null").select("graph_id", (F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "val")


def read_array(spark: SparkSession, path: str, graph_id: int) -> DataFrame:
    """Entries of an array file, column by column; zeros are kept."""
    h = read_header(spark, path)
    if h["format"] != "array" or h["field"] == "complex" or h["symmetry"] != "general":
        raise FormatError(path, "only general real array files are read")
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = text.agg(F.min("at").alias("first"))
    values = text.join(F.broadcast(first), F.col("at") > F.col("first")).select("at", F.trim("value").try_cast("double").alias("val"))
    parts = values.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"))
    starts = parts.select("part", "lo", (F.sum("n").over(_before()) - F.col("n")).alias("start"))
    k = F.col("start") + F.col("at") - F.col("lo")
    return values.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part").select(F.lit(graph_id).cast("long").alias("graph_id"), (k % h["m"]).alias("row"), F.floor(k / h["m"]).alias("col"), "val")


def _before():
    from pyspark.sql import Window as W

    return W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)  # one row for each input split


def _line(row: Column, col: Column, val: Column) -> Column:
    return F.concat_ws(" ", (row + 1).cast("string"), (col + 1).cast("string"), F.coalesce(val.cast("string"), F.lit("NaN")))


def entry_lines(entries: DataFrame) -> DataFrame:
    """(graph_id, line): 1-based coordinate lines in full precision, so that reading them gives the same values; NaN stands for a null."""
    return entries.select("graph_id", _line(F.col("row"), F.col("col"), F.col("val")).alias("line"))


def write_mtx(entries: DataFrame, path: str, m: int, n: int, symmetry: str = "general") -> None:
    """One matrix as a folder of text parts: a header part first, then the entries sorted by column.

    A file holds finite values only: a null, NaN or infinite one raises EntriesError.
    """
    spark = entries.sparkSession
    if not entries.filter(F.col("val").isNull() | F.isnan("val") | (F.abs("val") == float("inf"))).isEmpty():
        raise EntriesError(path, "a value is null, NaN or infinite")
    head = spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate real {symmetry}"), (0, 1, f"{m} {n} {entries.count()}")], "part int, at long, line string")
    body = entries.select(F.lit(1).alias("part"), "col", "row", _line(F.col("row"), F.col("col"), F.col("val")).alias("line"))
    ordered = head.select("part", F.lit(-1).cast("long").alias("col"), F.col("at").alias("row"), "line").unionByName(body.select("part", F.col("col").cast("long"), F.col("row").cast("long"), "line"))
    ordered.repartitionByRange("part", "col").sortWithinPartitions("part", "col", "row").select("line").write.text(path)


def append_records(records: DataFrame, path: str, columns: list[str]) -> None:
    """Metric records to CSV with a header; a record must have exactly ``columns``, all filled."""
    if sorted(records.columns) != sorted(columns):
        raise ValueError(f"columns {sorted(records.columns)}; expected {sorted(columns)}")
    empty = records.filter(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count()
    if empty:
        raise ValueError("a record lacks a value")
    records.select(*columns).write.mode("append").option("header", True).csv(path)
