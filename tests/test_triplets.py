import csv
import random

from pyspark.sql import functions as F

from levelweave.sources.triplets import invalid_values, parse_triplets, rejected_lines, valid_triplets

LINES = "line_id long, graph_id long, line_no int, line string"
GRAPHS = [(1, 100, "real"), (2, 50, "pattern"), (3, None, "real")]


def judge(spark, pairs):
    lines = spark.createDataFrame([(i, g, i, text) for i, (g, text) in enumerate(pairs)], LINES)
    graphs = spark.createDataFrame(GRAPHS, "graph_id long, n long, field string")
    return {r["line_id"]: r for r in parse_triplets(lines, graphs).collect()}


CASES = [
    (1, "1,2,3.5", None), (1, " 1 , 2 , 3.5 ", None), (1, '"1","2","3.5"', None), (1, '" 1 ",2,\t3', None), (1, "007,2,+1e3", None), (1, "1,2,-0.5E-2", None),
    (1, "1,2", "columns"), (2, "1,2", None), (2, "1,2,9", "columns"), (2, "1,2,", "columns"), (2, ",1,2", "columns"), (1, "1,2,3,4", "columns"), (1, "", "columns"), (1, None, "columns"), (1, "1 2 3", "columns"), (1, "1;2;3", "columns"),
    (1, '"1,2,3', "quoting"), (1, '1,2"2,3', "quoting"), (1, '1,"2"2,3', "quoting"), (1, '"1""",2,3', "value"), (1, '"1,2",3', "columns"), (2, '"1,2",3', "value"), (1, '"1" "2",3,4', "quoting"), (1, '1,2,""', "value"),
    (1, "0,1,1", "value"), (1, "101,1,1", "value"), (1, "1,101,1", "value"), (2, "51,1", "value"), (1, "1.0,1,1", "value"), (1, "1,2,nan", "value"), (1, "1,2,1e999", "value"), (1, "1,2,.5", "value"), (1, "1,2,5.", "value"),
    (1, "1,2,0x1p3", "value"), (1, "１,2,3", "value"), (1, "1,2,−3", "value"), (1, "1,2,", "value"), (1, ",,", "value"), (1, "99999999999999999999999999,1,1", "value"), (1, "-1,1,1", "value"), (1, "1,2,1_0", "value"),
    (3, "1,2,3", "value"), (9, "1,2,3", "value"), (1, '"1', "quoting"), (1, '1,2,"3"x', "quoting"), (1, '"1"x"",2,3', "quoting"), (1, "1,2,3\n", "value"), (1, '1,2,"3,1"', "value"),
]


def test_cases(spark):
    got = judge(spark, [(g, text) for g, text, _ in CASES])
    for i, (g, text, reason) in enumerate(CASES):
        assert got[i]["reason"] == reason, (g, text, got[i])
    assert (got[0]["row"], got[0]["col"], got[0]["val"]) == (1, 2, 3.5)
    assert got[7]["val"] == 1.0  # a pattern line


def test_comments_are_neither(spark):
    assert judge(spark, [(1, "% x"), (1, '%"'), (1, " % x")]).keys() == {2}


def test_long_lines(spark):
    got = judge(spark, [(1, "1," * 100_000), (1, '"' + '""' * 100_000 + '",1,1'), (1, "1,1,0." + "1" * 50_000)])
    assert [got[i]["reason"] for i in range(3)] == ["columns", "value", None]


def test_repeats_extra_columns_and_empty_tables(spark):
    lines = spark.createDataFrame([(1, 1, 1, "1,1,1"), (1, 1, 1, "1,1,1"), (2, 1, 2, "x")], LINES)
    for name in ("n", "field", "f", "row", "col", "val", "reason", "detail", "quoted_ok", "is_pattern", "row_text", "row_bad", "kind", "text", "uses", "row_most", "_g"):
        lines = lines.withColumn(name, F.lit("z"))
    graphs = spark.createDataFrame([(1, 9, "real"), (1, 5, "real")], "graph_id long, n long, field string").withColumn("line", F.lit("q")).withColumn("m", F.lit("z"))
    parsed = parse_triplets(lines, graphs)
    assert valid_triplets(parsed).count() == 2 and rejected_lines(parsed).count() == 1
    empty = spark.createDataFrame([], LINES)
    assert parse_triplets(empty, graphs).count() == 0
    assert parse_triplets(lines, graphs.limit(0)).filter("reason is null").count() == 0


def reference(line, pattern, n):
    """The rules, character by character."""
    fields, i, quoted_error = [], 0, False
    while True:
        while i < len(line) and line[i] in " \t":
            i += 1
        if i < len(line) and line[i] == '"':
            i, text, closed = i + 1, "", False
            while i < len(line):
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    closed, i = True, i + 1
                    break
                text, i = text + line[i], i + 1
            while i < len(line) and line[i] in " \t":
                i += 1
            if not closed or (i < len(line) and line[i] != ","):
                return "quoting"
            fields.append(text.strip(" \t"))
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            quoted_error |= '"' in line[i:j]
            fields.append(line[i:j].strip(" \t"))
            i = j
        if i >= len(line):
            break
        i += 1
    if quoted_error:
        return "quoting"
    if len(fields) != (2 if pattern else 3):
        return "columns"
    good = all(f.isascii() and f.isdigit() and 1 <= int(f) <= n for f in fields[:2])
    return None if good and (len(fields) == 2 or fields[2].isdigit()) else "value"


def test_random_quoting(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice('12,," \t""x') for _ in range(rnd.randrange(1, 12))) for _ in range(4000)]
    got = judge(spark, [(1 + (i % 2), t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert got[i]["reason"] == reference(t, i % 2 == 1, 100 if i % 2 == 0 else 50), repr(t)


def test_rows_of_the_csv_module(spark):
    rnd = random.Random(6)
    rows = [[rnd.choice(['1', '2,3', '4"5', "", " 7 "]) for _ in range(3)] for _ in range(300)]

    class Sink(list):
        write = list.append

    sink = Sink()
    csv.writer(sink, lineterminator="").writerows(rows)
    got = judge(spark, [(1, t) for t in sink])
    assert {r["reason"] for r in got.values()} <= {None, "value"}


def test_two_bounds_and_one_cast_a_text(spark):
    lines = spark.createDataFrame([(1, 1, 1, "3,2"), (2, 1, 2, "3,3"), (3, 1, 3, "4,1"), (4, None, 4, "1,1")], LINES)
    graphs = spark.createDataFrame([(1, 3, 2, "pattern")], "graph_id long, m long, n long, field string")
    parsed = parse_triplets(lines, graphs, row_bound="m")
    assert {r["line_id"]: r["detail"] for r in parsed.collect()} == {1: None, 2: "above_n", 3: "above_n", 4: "wrong_count"}
    split = spark.createDataFrame([(1, 5, 5, "1", "2", "x")] * 9, "graph_id long, row_most long, col_most long, row_text string, col_text string, val_text string")
    bad = invalid_values(split)
    assert [tuple(r) for r in bad.collect()] == [("val", None, "x", "not_decimal", 9)]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert "DOUBLE" not in plan[plan.index("Aggregate") :] and "double" not in plan[plan.index("Aggregate") :]
