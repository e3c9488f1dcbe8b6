import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelweave.llm.toxicity import Model, Words, _statistics, canonical, fit, picked, plain, rates, raw_tokens, score, spoken

NAMES = [a + b + c for a in ("mer", "tal", "vin", "sko") for b in ("ba", "lu", "ki", "ro") for c in ("dor", "nek", "sta")]
SLURS = ["grobnik", "flamsel", "dworpit", "snarlup", "quobbert"]
PLAIN = ["The table {n} holds {k} rows.", "We load {n} before the loop starts.", "Compared with {n} the run takes {k} ms.", "The word {s} is in the list of {n}.", "Note that {n} was exported on day {k}."]
BAD = ["You are a {s} and everybody knows it.", "Get lost {s}, nobody wants you here.", "Whoever wrote {n} is a {s}, crawl back to your hole."]


def corpus(seed, n, share=0.2):
    rnd = random.Random(seed)
    fill = lambda t: t.format(n=rnd.choice(NAMES), k=rnd.randrange(100), s=rnd.choice(SLURS))
    docs = []
    for d in range(n):
        lines = [fill(rnd.choice(PLAIN)) for _ in range(rnd.randrange(4, 12))]
        toxic = rnd.random() < share
        if toxic:
            lines.insert(rnd.randrange(len(lines)), disguise(rnd, fill(rnd.choice(BAD))))
        docs.append((seed * 10_000 + d, "\n".join(lines), rnd.choice(["a", "b", None]), toxic))
    return docs


def disguise(rnd, line):
    kind = rnd.randrange(5)
    if kind == 1:
        return line.upper()
    if kind == 2:
        return line.replace("o", "о")
    if kind == 3:
        return line.replace("you", "y0u").replace("e ", "ee ")
    return line


def test_held_out_accuracy(spark):
    train, test = corpus(1, 700), corpus(2, 500)
    rnd = random.Random(3)
    marks = [(d, int(t if rnd.random() > 0.1 else not t)) for d, _, _, t in train]  # one mark in ten is wrong
    schema = "doc_id long, text string, source string, truth boolean"
    docs = spark.createDataFrame(train + test, schema)
    labels = spark.createDataFrame([(d, t, 3) for d, t in marks], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["toxic"] for r in score(docs, labels).collect()}
    truth = {d: t for d, _, _, t in test}
    hit = sum(got[d] and t for d, t in truth.items())
    assert hit / sum(truth.values()) > 0.9
    assert hit / max(1, sum(got[d] for d in truth)) > 0.9
    shares = {r["source"]: r for r in rates(score(docs, labels)).collect()}
    assert set(shares) == {"a", "b", None} and all(0 < r["rate"] < 0.5 for r in shares.values())


def test_cases(spark):
    rows = corpus(1, 300)
    labels = spark.createDataFrame([(d, int(t)) for d, _, _, t in rows] + [(None, 1), (7, None), (rows[0][0], None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in rows] + [(1, None), (2, ""), (2, ""), (None, "Hello."), (3, "word " * 200_000)], "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit("y"))
    got = score(docs, labels).collect()
    assert len(got) == len(rows) + 5
    assert all(r["score"] == 0 and not r["toxic"] for r in got if r["doc_id"] in (1, 2))
    none = score(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and not any(r["toxic"] for r in none)
    assert score(docs.limit(0), labels).count() == 0
    assert fit(docs, labels.filter("toxic = 1")) is None


def test_disguised_words():
    words = Words(["grobnik", "stupid", "you", "are"])
    same = words.ids["grobnik"]
    for w in ("grobnik", "GROBNIK", "gr0bn1k", "grrrobniik", "gro*nik", "gr@bnik"):
        assert words.of(w) == (same,), w
    assert words.encode(["g", "r", "o", "b", "n", "i", "k"]).tolist() == [same]
    assert [words.names[i] for i in words.of("youAreGrobnik")] == ["you", "are", "grobnik"]
    assert canonical("1234") == "<n>" and words.of("zzyzx") == (0,)
    assert raw_tokens("a​b сd!\ne", None) == ["ab", "cd", "!", "\n", "e", "\n", "\n"] or raw_tokens("a​b сd!\ne", None)[:2] == ["ab", "cd"]


def textbook(rows, size, u, v, w, less_t=0, less_n=0, d=0.75):
    """(abusive, ordinary) probability of w after u, v by the sums of the definition; ``rows`` is {(u, v, w): (t, n)}."""
    cont = {(b, c) for _, b, c in rows}
    p1 = np.array([0.5 + sum(c == k for _, c in cont) for k in range(size)])
    p = (p1 / p1.sum())[w]

    def chain(base, n):
        seen = {k for k, x in n.items() if x > 0}
        after_v = [k for k in seen if k[1] == v]
        if after_v:
            base = max(sum(k[2] == w for k in after_v) - d, 0) / len(after_v) + d * len({k[2] for k in after_v}) / len(after_v) * base
        after_uv = [k for k in seen if k[:2] == (u, v)]
        if after_uv:
            total = sum(n[k] for k in after_uv)
            base = max(n.get((u, v, w), 0) - d, 0) / total + d * len(after_uv) / total * base
        return base

    ordinary = chain(p, {k: x[1] - less_n for k, x in rows.items()})
    return chain(ordinary, {k: x[0] - less_t for k, x in rows.items()}), ordinary


@pytest.fixture(scope="module")
def small(spark):
    rnd = np.random.default_rng(2)
    size = 6
    rows = {}
    for _ in range(70):
        u, v, w = (int(x) for x in rnd.integers(0, size, 3))
        rows[(2, 2, w) if v == 2 else (u, v, w)] = (int(rnd.integers(0, 4)) * int(rnd.integers(0, 2)), int(rnd.integers(0, 4)))
    counted = spark.createDataFrame([(u * size + v, w, t, n) for (u, v, w), (t, n) in rows.items()], "ctx long, w int, t long, n long")
    return size, rows, Model(size, _statistics(counted, size).toPandas())


def test_differences_against_textbook(small):
    """Every position, with and without the document's own counts."""
    size, rows, model = small
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, size, 600)
    own_t, own_n = rnd.integers(0, 2, (2, 600)).astype(bool)
    for a, b in ((None, None), (own_t, own_n)):
        diff = model.differences(ids, a, b)
        for i in range(2, len(ids)):
            u, v = (2, 2) if ids[i - 1] == 2 else (int(ids[i - 2]), int(ids[i - 1]))
            want = textbook(rows, size, u, v, int(ids[i]), int(a is not None and a[i]), int(b is not None and b[i]))
            assert diff[i] == pytest.approx(np.log(want[0]) - np.log(want[1]), abs=1e-9), i


def test_model_is_a_distribution(small):
    """The probabilities of both classes sum to one over the vocabulary after any two words."""
    size, rows, model = small
    for u in range(size):
        for v in range(size):
            c = (2, 2) if v == 2 else (u, v)
            both = np.array([textbook(rows, size, *c, w) for w in range(size)])
            assert both.sum(axis=0) == pytest.approx([1, 1])
            ids = np.array([x for w in range(size) for x in (2, *c, w)])  # contexts one by one
            got = np.exp(model.differences(ids)[3::4]) * both[:, 1]
            assert got.sum() == pytest.approx(1)


def test_scores_are_normalised_sums(small):
    size, _, model = small
    ids = np.array([3, 4, 5, 2, 2, 1, 3, 4, 2])
    ends, got = model.scores(ids)
    diff = model.differences(ids)
    assert ends.tolist() == [3, 4, 8]
    assert got == pytest.approx([diff[:4].sum() / (4 + Model.PAD), diff[4] / (1 + Model.PAD), diff[5:].sum() / (4 + Model.PAD)])
    assert model.scores(np.array([], dtype=int))[1].tolist() == []


def test_what_contradicts_the_mark_is_in_neither_class():
    class Fixed:
        def scores(self, ids, *own):
            return np.array([1, 3, 5, 7]), np.array([9.0, 0.0, 9.0, 0.0])

    ids, toxic = np.array([5, 2] * 4), np.array([True] * 4 + [False] * 4)
    abusive, ordinary = picked(ids, toxic, [Fixed()], 1.5)
    assert abusive.tolist() == [True] * 2 + [False] * 6 and ordinary.tolist() == [False] * 6 + [True] * 2
    assert picked(ids, toxic, [], 1.5)[0].tolist() == toxic.tolist()


def test_plain_and_joined_words():
    assert [plain(w) for w in ("word", "Word", "WORD", "youAre", "f*ck", "a1")] == [True, True, True, False, False, True]
    assert spoken({"youAreGrobnik", "Stupid", "m*n"}) == {"you", "are", "grobnik", "stupid"}


def test_rare_insults_count(spark):
    """A word that one marked document has in a known frame is learnt with it, however rare: no n-gram is left out for its count."""
    rows = corpus(1, 500)
    odd = [(9001, "We load merbador before the loop starts.\nGet lost zwirkel, nobody wants you here.", "a", True)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, source string, truth boolean")
    labels = spark.createDataFrame([(d, int(t)) for d, _, _, t in rows + odd], "doc_id long, toxic int")
    fitted = fit(docs, labels)
    ids = fitted.words.encode(raw_tokens("Get lost zwirkel\nzwirkel, nobody wants you", None))
    known = fitted.words.ids["zwirkel"]
    tri = fitted.model.abusive[0]
    assert known in (tri.bi % fitted.model.size).tolist() and (ids == known).sum() == 2


def test_words_past_the_cache_are_whole():
    words = Words(["grobnik", "stupid", "you", "are"])
    fresh = words.encode(["youAreGrobnik", "stupidGrobnik"]).tolist()
    words = Words(["grobnik", "stupid", "you", "are"])
    words.encode([f"w{i}" for i in range(500_000)])
    assert words.encode(["youAreGrobnik", "stupidGrobnik"]).tolist() == fresh
    assert len(words.cache) < 500_000
