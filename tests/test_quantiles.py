import math
import random

from pyspark.sql import functions as F

from levelweave.functions.quantiles import latest, percentiles, value_counts

SCHEMA = "k string, day int, x double"


def exact(values, p):
    v = sorted(values)
    return v[max(1, (p * len(v) + 999) // 1000) - 1]


def test_against_sorting(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randrange(5), rnd.choice([rnd.random(), 0.5, -1.0, 0.0])) for _ in range(3000)]
    state = value_counts(spark.createDataFrame(rows, SCHEMA), ["k"], ["x"], F.col("day"))
    for days in ([0, 1, 2, 3, 4], [1, 3], [2]):
        got = {(r["k"], r["permille"]): (r["percentile"], r["n"]) for r in percentiles(state.filter(F.col("part").isin(days)), ["k", "metric"], [0, 500, 900, 1000]).collect()}
        for k in {r[0] for r in rows}:
            mine = [x for kk, d, x in rows if kk == k and d in days]
            if mine:
                for p in (0, 500, 900, 1000):
                    assert got[k, p] == (exact(mine, p), len(mine))


def test_states_of_parts_combine(spark):
    rows = [("a", d, float(i % 17)) for d in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = value_counts(df, ["k"], ["x"], F.col("day"))
    parts = [value_counts(df.filter(F.col("day") == d), ["k"], ["x"], F.col("day")) for d in range(3)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    a, b = (percentiles(s, ["k", "metric"], [250, 500]).collect() for s in (whole, united))
    assert sorted(a) == sorted(b)


def test_relative_error(spark):
    rnd = random.Random(2)
    values = [math.exp(rnd.gauss(0, 4)) * rnd.choice([1, -1]) for _ in range(2000)] + [0.0] * 5
    state = value_counts(spark.createDataFrame([("a", 0, v) for v in values], SCHEMA), ["k"], ["x"], F.col("day"), rel_error=0.01)
    assert state.count() < 1700
    for r in percentiles(state, ["k", "metric"], [10, 500, 990]).collect():
        want = exact(values, r["permille"])
        assert abs(r["percentile"] - want) <= 0.01 * abs(want) + 1e-12


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 0, float("nan")), ("a", 0, float("inf")), ("b", 0, 1.0), ("b", None, 1.0)], SCHEMA).withColumn("value", F.lit("z")).withColumn("n", F.lit(1)).withColumn("metric", F.lit(2))
    got = percentiles(value_counts(df, ["k"], ["x"], F.col("day")), ["k", "metric"], [500]).collect()
    assert [(r["k"], r["percentile"], r["n"]) for r in got] == [("b", 1.0, 2)]
    assert percentiles(value_counts(df.limit(0), ["k"], ["x"], F.col("day")), ["k", "metric"], [500]).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (None, 1, "x"), (None, 1, "y"), (2, None, "only")], "id long, t int, v string")
    assert sorted(r["v"] for r in latest(df, "id", "t").collect()) == ["new", "only", "x", "y"]
