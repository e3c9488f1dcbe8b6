import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelweave.llm.packing import container_fill, count_tokens, encoding, first_fit_decreasing, pack

DOCS = "doc_id long, text string"


def plain_ffd(sizes, capacity):
    rooms, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for k, room in enumerate(rooms):
            if room >= sizes[i]:
                break
        else:
            k = len(rooms)
            rooms.append(capacity)
        rooms[k] -= sizes[i]
        place[i] = k
    return place


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit_decreasing(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 5, 7, 50, 99, 100, rnd.randrange(101)]) for _ in range(rnd.randrange(1, 300))]
    assert first_fit_decreasing(np.array(sizes), 100).tolist() == plain_ffd(sizes, 100)


def test_pack(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "matrix", "42", "\n"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 30, 90, 400])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "alpha"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("x")).withColumn("total", F.lit(1)).withColumn("group", F.lit(1))
    got = pack(df, capacity=100, group_items=120).collect()
    enc = encoding("/opt/tokenizers")
    sizes = sorted(len(enc.encode_ordinary(t or "")) for _, t in rows)
    whole = {}
    loads = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r)
        loads.setdefault(r["container"], []).append(r)
    assert sum(r["tokens"] for r in got) == sum(sizes)
    for d, parts in whole.items():
        if d not in (None, 5):
            assert sorted(p["piece"] for p in parts) == list(range(parts[0]["pieces"]))
            total = sum(p["tokens"] for p in parts)
            assert parts[0]["pieces"] == max(1, -(-total // 100))
    for parts in loads.values():
        at = 0
        for k, p in enumerate(sorted(parts, key=lambda p: p["place"])):
            assert (p["place"], p["offset"]) == (k, at)
            at += p["tokens"]
        assert at <= 100
    assert len(loads) <= sum(sizes) / 100 * 1.1 + 4
    assert sum(r["n"] for r in [{"n": len(v)} for v in loads.values()]) == container_fill(pack(df, capacity=100)).agg(F.sum("items")).first()[0]
    assert len(whole[1000]) == len(whole[1001]) == 1 and len(whole[5]) >= 3


def test_empty(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_counted_whole():
    enc = encoding("/opt/tokenizers")
    for text in ("word and number 12345,  " * 20_000, "x" * 450_000, " " * 300_000, "ab\n\n " * 90_000):
        assert count_tokens(text, enc) == len(enc.encode_ordinary(text))
    assert count_tokens(None, enc) == 0


def test_layout_of_files_does_not_matter(spark):
    rows = [(i % 40 if i % 3 else None, "alpha beta " * (i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    layouts = [sorted((tuple(r) for r in pack(df.repartition(n), capacity=50, group_items=60).collect()), key=repr) for n in (1, 7)]
    assert layouts[0] == layouts[1] and len(layouts[0]) == 400
