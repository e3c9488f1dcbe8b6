import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelweave.llm.leakage import Index, distance_within, document_words, leaked, runs_between, sentences
from levelweave.llm.text import plain_words, readable, unmarked

WORDS = [f"w{i}" for i in range(400)]


def best_distance(pattern, text):
    """Sellers' table: least edits of the pattern against any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != w), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("seed", range(5))
def test_bit_parallel_distance(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        pattern = [rnd.randrange(5) for _ in range(rnd.randrange(1, 22))]
        text = [rnd.randrange(5) for _ in range(rnd.randrange(0, 30))]
        for errors in (0, 1, 2, 4):
            assert distance_within(pattern, np.array(text), errors) == (best_distance(pattern, text) <= errors and bool(text))


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        k, kind = rnd.randrange(len(words)), rnd.randrange(3)
        if kind == 0:
            words[k] = "other"
        elif kind == 1:
            del words[k]
        else:
            words.insert(k, "other")
    return words


def test_against_brute_force(spark):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([10, 20, 25, 40])))) for i in range(15)]
    docs = []
    for d in range(250):
        text = [rnd.choice(WORDS) for _ in range(rnd.randrange(40))]
        item = rnd.choice(items)[1].split()
        a = rnd.randrange(max(1, len(item) - 11))
        piece = edited(rnd, item[a : a + rnd.choice([12, 18, 19, 20, 21, 22, 26])], rnd.randrange(5))
        docs.append((d, " ".join([*text[:9], *piece, *text[9:]])))
    want = set()
    for d, t in docs:
        for i, x in items:
            x = x.split()
            if any(best_distance(x[j : j + 20], t.split()) <= 2 for j in range(len(x) - 19)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaked(df, it).collect()} == want and len(want) > 40
    assert {tuple(r) for r in leaked(df, it, block_words=200).collect()} == want  # items in blocks


PASSAGE = "After nine days Merzan's brother repaired the old anchor and sailed north towards the café where Lumpra met a fiddler from Kivetal again"


def notebook(*cells):
    return json.dumps({"cells": [{"cell_type": "markdown", "source": c, "metadata": {}} for c in cells]})


DISGUISES = [
    PASSAGE.upper(),
    PASSAGE.replace("é", "é").replace("'", "’"),
    " ".join(f"**{w}**" if i % 2 else f"<b>{w}</b>" for i, w in enumerate(PASSAGE.split())),
    PASSAGE.replace(" ", " ").replace("'", "&#39;"),
    "# %% [markdown]\n# " + PASSAGE[:70] + "\n\n# %% [markdown]\n# " + PASSAGE[70:],
    notebook("x", PASSAGE[:62].split(" ")[0] + PASSAGE[len(PASSAGE.split(" ")[0]) :]),
    notebook("intro", " ".join(PASSAGE.split()[:11]), " ".join(PASSAGE.split()[11:])),
    "In [3]:\n```python\nask('''" + PASSAGE.replace(" ", "\n") + "''')\n```",
    "# -> " + PASSAGE[:50] + "\n# -> \x1b[0;31m" + PASSAGE[50:] + "\x1b[0m",
    json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1"], "outputs": [{"text": [PASSAGE + "\n"]}]}]}),
    '{"cells": [{"source": "' + PASSAGE.replace("é", "\\u00e9") + '"',  # cut off
    "| 8 | " + PASSAGE + " |",
]


@pytest.mark.parametrize("text", DISGUISES)
def test_disguises(text):
    index = Index({1: runs_between(sentences(PASSAGE), set())}, 20, 2)
    assert index.find(document_words(text, None)) == {1}


@pytest.mark.parametrize("block_words", [2_000_000, 120])
def test_shared_instructions_do_not_count(spark, block_words):
    """Nor where each of them stands in a block of its own."""
    lead = "Think about this step by step and give only one final number as the answer to what is asked below please."
    rnd = random.Random(1)
    texts = [lead + " " + " ".join(rnd.choice(WORDS) for _ in range(30)) for _ in range(6)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + lead), (2, texts[3])], "doc_id long, text string")
    assert [tuple(r) for r in leaked(docs, items, block_words=block_words).collect()] == [(2, 3)]


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, PASSAGE), (3, PASSAGE), (4, "{"), (5, "x " * 300_000 + PASSAGE)], "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("fmt", F.lit(None).cast("string"))
    items = spark.createDataFrame([(7, PASSAGE), (8, None), (9, "too short"), (None, PASSAGE)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in leaked(docs, items).collect()} == {(3, 7), (5, 7)}
    assert leaked(docs, items).count() == 2
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0


def test_words():
    assert plain_words("Ça, L'été 42 über_alles 我们") == ["ca", "lete", "42", "uber", "alles", "我", "们"]
    assert unmarked("a<br/>b \x1b[0;31mred\x1b[0m &amp; x\\ny").split() == ["a", "b", "red", "&", "x", "y"]
    assert readable(None) == ("", "")
