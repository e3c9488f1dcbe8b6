import datetime

import pytest

from levelweave.sources import generators, matrix_market
from levelweave.sources.errors import EntriesError, FormatError, HeaderError
from levelweave.streaming.ingest import daily_counts, ingest_triplets

HEAD = "%%MatrixMarket matrix coordinate {} {}\n% a comment\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read(spark, tmp_path):
    at = write(tmp_path / "a.mtx", HEAD.format("real", "symmetric") + "3 3 4\n3 1 2.5\n1 1 1\n\n2 2 -1e2\n3 3 4\n")
    assert matrix_market.read_header(spark, at) == {"format": "coordinate", "field": "real", "symmetry": "symmetric", "m": 3, "n": 3, "nnz": 4}
    assert {tuple(r) for r in matrix_market.read_mtx(spark, at, 7).collect()} == {(7, 2, 0, 2.5), (7, 0, 0, 1.0), (7, 1, 1, -100.0), (7, 2, 2, 4.0)}
    at = write(tmp_path / "p.mtx", HEAD.format("pattern", "general") + "2 2 1\n2 1\n")
    assert [tuple(r) for r in matrix_market.read_mtx(spark, at, 1).collect()] == [(1, 1, 0, 1.0)]


def test_errors(spark, tmp_path):
    for text, error in (("3 3 1\n", HeaderError), (HEAD.format("real", "odd") + "1 1 0\n", HeaderError), (HEAD.format("real", "general") + "1 1\n", HeaderError), (HEAD.format("complex", "general") + "1 1 1\n1 1 1 1\n", FormatError), (HEAD.format("real", "general") + "2 2 2\n1 1 1\n", EntriesError), (HEAD.format("real", "general") + "2 2 1\n3 1 1\n", EntriesError)):
        with pytest.raises(error):
            matrix_market.read_mtx(spark, write(tmp_path / "x.mtx", text), 1).count()


def test_bounds_and_kinds(spark, tmp_path):
    at = write(tmp_path / "w.mtx", HEAD.format("real", "general") + "2 5 2\n2 5 1\n1 4 2\n")
    assert {tuple(r)[1:3] for r in matrix_market.read_mtx(spark, at, 1).collect()} == {(1, 4), (0, 3)}
    for text, error in ((HEAD.format("real", "general") + "2 5 1\n5 1 1\n", EntriesError), (HEAD.format("real", "skew-symmetric") + "2 2 1\n2 1 1\n", FormatError), (HEAD.format("real", "hermitian") + "2 2 1\n2 1 1\n", FormatError)):
        with pytest.raises(error):
            matrix_market.read_mtx(spark, write(tmp_path / "x.mtx", text), 1).count()
    odd = spark.createDataFrame([(1, 0, 0, None)], "graph_id long, row long, col long, val double")
    assert [r["line"] for r in matrix_market.entry_lines(odd).collect()] == ["1 1 NaN"]
    with pytest.raises(EntriesError):
        matrix_market.write_mtx(odd, str(tmp_path / "odd"), 1, 1)


def test_round_trip(spark, tmp_path):
    rows = [(1, i, j, 1 / (i + j + 1)) for i in range(20) for j in range(i + 1)]
    m = spark.createDataFrame(rows, "graph_id long, row long, col long, val double")
    matrix_market.write_mtx(m, str(tmp_path / "out"), 20, 20)
    assert {tuple(r) for r in matrix_market.read_mtx(spark, str(tmp_path / "out"), 1).collect()} == set(rows)


def test_array(spark, tmp_path):
    at = write(tmp_path / "d.mtx", "%%MatrixMarket matrix array real general\n2 3\n1\n2\n3\n4\n5\n6\n")
    assert {tuple(r)[1:] for r in matrix_market.read_array(spark, at, 1).collect()} == {(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0), (0, 2, 5.0), (1, 2, 6.0)}


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "name string, t double")
    matrix_market.append_records(df, str(tmp_path / "log"), ["name", "t"])
    matrix_market.append_records(df, str(tmp_path / "log"), ["name", "t"])
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        matrix_market.append_records(df.withColumnRenamed("t", "u"), str(tmp_path / "log"), ["name", "t"])


def test_generators(spark):
    sizes = spark.createDataFrame([(1, 50)], "graph_id long, n long")
    m = generators.random_square(sizes, 0.1).collect()
    assert {(r["row"], r["col"]) for r in m} >= {(k, k) for k in range(50)}
    assert all(0 <= r["row"] < 50 and 0 <= r["val"] < 1e4 for r in m) and 50 * 4 < len(m) <= 50 * 6
    assert len({tuple(sorted((r["row"] - r["col"]) % 50 for r in m if r["col"] == c)) for c in range(50)}) > 40
    assert generators.sampled(spark.range(100), 7).distinct().count() == 7


def test_streams(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 1, "1,1,2.0"), (2, 1, 2, "1;1"), (3, 1, 3, '"1'), (4, 1, 4, "2,1,1")], "line_id long, graph_id long, line_no int, line string")
    graphs = spark.createDataFrame([(1, 9, "real")], "graph_id long, n long, field string")
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    ingest_triplets(stream, graphs, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    assert {r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"columns", "quoting"}
    t = datetime.datetime(2025, 3, 3)
    runs = spark.createDataFrame([(1, "a", 1.0, 2.0, t), (1, "a", 1.0, 2.0, t), (2, "a", 1.0, None, t)], "record_id long, fname string, t_serial double, t_level double, run_ts timestamp")
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    counts = daily_counts(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs")))
    counts.writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start().awaitTermination(120)
    got = {(r["metric"], r["value"]): r["n"] for r in spark.table("counts").collect()}
    assert got == {("t_serial", 1.0): 2, ("t_level", 2.0): 1}
    assert {r["part"] for r in spark.table("counts").collect()} == {t.date()}
    plan = counts.writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()  # append needs a watermark on the groups
    plan.awaitTermination(120)
    assert plan.exception() is None
