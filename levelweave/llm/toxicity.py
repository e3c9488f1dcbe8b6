"""Scores for abusive, hateful or sexually explicit passages from two class-conditional Kneser-Ney models.

Passages (sentences and lines of every cell) become canonical words: case, accents, look-alike letters,
digits for letters, spread-out and doubled letters are undone. The ordinary class is an interpolated
Kneser-Ney trigram model whose lowest order pools the continuation counts of both classes; the abusive class is one
whose backoff is the ordinary model, so that where abusive text has shown nothing of its own, both
classes smooth a rare expression alike. Every n-gram counts, singletons included. The score of a
passage is its log-likelihood ratio, abusive over ordinary, normalised by its length; that of a document the greatest of its passages.

Reviewers mark documents, not passages, and sometimes wrongly. So the passages to learn from are picked first: the first
models take as abusive only n-grams that marked documents have clearly more often than others; the
passages they call abusive are counted in full for the next models, and those score all marked passages once
more, each without the counts of its own document. What contradicts its mark is in neither class.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.llm.text import readable, unmarked
from levelweave.plans.storage import cut

# Letters of other scripts that look like Latin ones, and characters written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ց": "g", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ɑ": "a", "ℓ": "l", "ß": "ss",
}
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"})
SYMBOLS = str.maketrans({"@": "a", "$": "s", "!": "i", "+": "t", "|": "l"})

_LOOK = re.compile("[" + "".join(LOOKALIKES) + "]")
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ️]+")
_TOKEN = re.compile(r"[㐀-鿿]|[@$]?[^\W_㐀-鿿]+(?:[@$*#!+|%&?]+[^\W_㐀-鿿]+)*|[.!?;](?=[\s\"')]|$)|[。！？\n]")
_ENDS = frozenset(".!?;。！？\n")
#: The row number that a printed table puts before a line.
_ROW = re.compile(r"^[ \t]*\d+[ \t]{2,}(?=[^\W\d])", re.M)
_RUNS = re.compile(r"(.)\1+")
_HUMP = re.compile(r"[A-Z]?[^\W\dA-Z]+|[A-Z]+|\d+")
_MASKS = re.compile(r"[@$*#!+|%&?]+")

NUMBER, OTHER, END = "<n>", "<u>", "</s>"


def cleaned(text: str) -> str:
    text = unmarked(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        text = _LOOK.sub(lambda m: LOOKALIKES[m.group()], text)
    return _ROW.sub("", text)


def raw_tokens(text: str | None, fmt: str | None) -> list[str]:
    """Words and passage ends of a document, in order."""
    out: list[str] = []
    for part in readable(text, fmt):
        if part:
            out += _TOKEN.findall(cleaned(part))
            out.append("\n")
    return out


def canonical(word: str) -> str:
    """One spelling for the disguises of a word that need no dictionary."""
    if word.isdigit():
        return NUMBER
    low = word.lower()
    if not low.isalpha():
        low = low.translate(SYMBOLS)
        if any(c.isalpha() for c in low):
            low = low.translate(DIGITS)
    return _RUNS.sub(r"\1", low)


def plain(word: str) -> bool:
    """Whether a token is one word in no disguise: neither masked, nor joined from several by capitals."""
    return word.isalnum() and (word.islower() or word.isupper() or word.istitle() or word.isdigit() or not word.isascii())


def spoken(tokens: set[str]) -> set[str]:
    """Canonical words for the vocabulary: plain tokens, and the parts of joined ones."""
    out: set[str] = set()
    for x in tokens:
        if plain(x):
            out.add(canonical(x))
        else:
            for p in _MASKS.split(x):
                parts = _HUMP.findall(p)
                if len(parts) > 1:
                    out.update(map(canonical, parts))
    return out


class Words:
    """Ids of canonical words, with spread-out, masked and joined words resolved against the vocabulary, the most frequent first."""

    #: Tokens kept in the cache before it is emptied.
    MOST = 500_000

    def __init__(self, vocabulary: list[str]):
        letters = list("abcdefghijklmnopqrstuvwxyz")
        fixed = {OTHER, NUMBER, END, *letters, *_ENDS}
        self.names = [OTHER, NUMBER, END, *letters, *(w for w in dict.fromkeys(vocabulary) if w not in fixed)]
        self.ids = {w: i for i, w in enumerate(self.names)}
        self.by_length: dict[int, list[str]] = {}
        for w in self.names[29:]:
            if len(w) >= 5:
                self.by_length.setdefault(len(w), []).append(w)
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = dict.fromkeys(_ENDS, 2)
        self.several: list[tuple[int, ...]] = [()]

    def of(self, word: str) -> tuple[int, ...]:
        got = self.ids.get(canonical(word))
        if got is None and (masked := _MASKS.sub("*", word.lower()).translate(DIGITS)).count("*") == 1:
            got = self._unmasked(_RUNS.sub(r"\1", masked))
        if got is None and (_MASKS.search(word) or not (word.islower() or word.isupper())):
            parts = [h for p in _MASKS.split(word) for h in _HUMP.findall(p)]
            ids = tuple(self.ids.get(canonical(p), 0) for p in parts)
            if len(parts) > 1 and any(i > 1 for i in ids):
                return ids
        return (got or 0,)

    def _unmasked(self, masked: str) -> int | None:
        """The most frequent word that differs in the masked letter only, which is not the first."""
        begin, end = masked.split("*")
        if begin:
            for w in self.by_length.get(len(masked), ()):
                if w.startswith(begin) and w.endswith(end):
                    return self.ids[w]
        return None

    def _new(self, word: str) -> int:
        ids = self.of(word)
        if len(ids) == 1:
            code = ids[0]
        else:
            code = -len(self.several)  # words of several ids are kept aside
            self.several.append(ids)
        self.cache[word] = code
        return code

    def encode(self, tokens: list[str]) -> np.ndarray:
        """Ids of tokens; passages end with the id of END. Four letters or more in a row make a word."""
        if len(self.cache) >= self.MOST:  # between texts, so that no word of one is read otherwise
            self._forget()
        ids = list(map(self.cache.get, tokens))
        if None in ids:
            ids = [self._new(t) if i is None else i for t, i in zip(tokens, ids)]
        out = np.array(ids, dtype=np.int64)
        if len(out) and out.min() < 0:
            out = np.array([k for i in ids for k in ((i,) if i >= 0 else self.several[-i])], dtype=np.int64)
        single = np.concatenate([[0], ((out >= 3) & (out < 29)).astype(np.int8), [0]])
        edge = np.diff(single)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for b, e in reversed([(b, e) for b, e in zip(begin, end) if e - b >= 4]):
            word = "".join(self.names[i] for i in out[b:e])
            joined = [self.ids.get(canonical(word))] if canonical(word) in self.ids else [int(out[b]), self.of(word[1:])[0]] if canonical(word[1:]) in self.ids else [0]
            out = np.concatenate([out[:b], joined, out[e:]])
        return out


def contexts(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each position, and the code of the two before; END stands for what precedes a passage."""
    ids = ids.astype(np.int64)
    if not len(ids):
        return ids, ids
    last = np.concatenate([[2], ids[:-1]])
    before = np.concatenate([[2], last[:-1]])
    return last, np.where(last == 2, 2, before) * size + last


def sketch(tokens: list[str], cache: dict[str, int], run: int = 8) -> int:
    """Least hash of a text's runs of ``run`` tokens: equal for copies, and for edited copies as often as they are alike."""
    codes = np.array([cache.setdefault(t, zlib.crc32(t.lower().encode())) for t in tokens], dtype=np.uint64)
    n = max(1, len(codes) - run + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(run, len(codes))):
        h = (h ^ (codes[k : k + n] + np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return int(h.min() >> np.uint64(1))


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where codes stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.searchsorted(table, codes)
    at[at == len(table)] = 0
    return at, table[at] == codes


def _share(discounted: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, np.maximum(discounted, 0) / np.maximum(total, 1), 0.0)


def _backoff(kinds: np.ndarray, total: np.ndarray, discount: float) -> np.ndarray:
    return np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)


class Abusive:
    """Discounted shares and backoff weights of the abusive trigrams (ctx, w, n); ``less`` takes one document off every count."""

    def __init__(self, size: int, ctx: np.ndarray, w: np.ndarray, n: np.ndarray, less: int, discount: float):
        keep = n > less
        bigrams = (ctx % size) * size + w
        self.bi = np.unique(bigrams)  # the same for both, so that positions can be looked up once
        self.ctx, of = np.unique(ctx, return_inverse=True)
        code = of * size + w
        order = np.argsort(code)
        self.tri = code[order]
        n = np.where(keep, n - less, 0).astype(float)
        last = self.bi // size
        continued = np.bincount(np.searchsorted(self.bi, bigrams), weights=keep, minlength=len(self.bi))
        total2, kinds2 = np.bincount(last, weights=continued, minlength=size), np.bincount(last, weights=continued > 0, minlength=size)
        self.q2, self.back2 = _share(continued - discount, total2[last]), _backoff(kinds2, total2, discount)
        total3, kinds3 = np.bincount(of, weights=n, minlength=len(self.ctx)), np.bincount(of, weights=keep, minlength=len(self.ctx))
        self.q3, self.back3 = _share(np.where(keep, n - discount, 0), total3[of])[order], _backoff(kinds3, total3, discount)


class Ordinary:
    """The ordinary model as far as scores need it: at bigrams that abusive text has.

    ``uni`` (last, total, kinds, of them seen twice ...), ``bi`` (last * size + w), ``ctx`` and ``tri`` are counts that Spark made.
    """

    def __init__(self, size: int, p1: np.ndarray, uni: pd.DataFrame, bi: pd.DataFrame, ctx: pd.DataFrame, tri: pd.DataFrame, less: int, discount: float):
        total, kinds, pairs = ("x1", "x2", "x1") if not less else ("x3", "x4", "x2")
        self.size, self.p1 = size, p1
        total2, kinds2 = np.zeros(size), np.zeros(size)
        total2[uni["k"]], kinds2[uni["k"]] = uni[total], uni[kinds]
        self.back2 = _backoff(kinds2, total2, discount)
        bi = bi.sort_values("k")
        self.bi = bi["k"].to_numpy(np.int64)
        self.q2 = _share(bi[pairs].to_numpy(float) - discount, total2[self.bi // size])
        ctx = ctx.sort_values("k")
        self.ctx = ctx["k"].to_numpy(np.int64)
        held = (ctx["x1"] - ctx["x2"] * less).to_numpy(float)
        self.back3 = _backoff(ctx["x3" if less else "x2"].to_numpy(float), held, discount)
        of = np.searchsorted(self.ctx, tri["k"].to_numpy(np.int64))
        code = of * size + tri["w"].to_numpy(np.int64)
        order = np.argsort(code)
        n = tri["x1"].to_numpy(float) - less
        self.tri, self.q3 = code[order], _share(np.where(n > 0, n - discount, 0), held[of] if len(of) else n)[order]

    def p(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        last = ctx % self.size
        at, known = _find(self.bi, last * self.size + ids)
        low = (np.where(known, self.q2[at], 0.0) if len(self.bi) else 0.0) + self.back2[last] * self.p1[ids]
        at, known = _find(self.ctx, ctx)
        if len(self.ctx):
            low = low * np.where(known, self.back3[at], 1.0)
        in3, known3 = _find(self.tri, np.where(known, at * self.size + ids, -1))
        return low + (np.where(known3, self.q3[in3], 0.0) if len(self.tri) else 0.0)


class Model:
    """Both classes' models; ``scores`` gives log-likelihood ratios of passages.

    ``rows`` holds the counts that Spark made, a row for each: ``kind``, key ``k`` and ``w`` and up to four figures.
    """

    D = 0.75
    #: Added to a passage's length, so that a word or two are no passage.
    PAD = 2.0

    def __init__(self, size: int, rows: pd.DataFrame):
        self.size = size
        of = {kind: rows[rows["kind"] == kind] for kind in ("abusive", "pool", "uni", "bi", "ctx", "tri")}
        p1 = np.full(size, 0.5)
        p1[of["pool"]["k"].to_numpy(np.int64)] += of["pool"]["x1"].to_numpy(float)
        a = of["abusive"]
        key = (a["k"].to_numpy(np.int64), a["w"].to_numpy(np.int64), a["x1"].to_numpy(np.int64))
        self.abusive = [Abusive(size, *key, less, self.D) for less in (0, 1)]
        self.ordinary = [Ordinary(size, p1 / p1.sum(), of["uni"], of["bi"], of["ctx"], of["tri"], less, self.D) for less in (0, 1)]

    def differences(self, ids: np.ndarray, own_abusive: np.ndarray | None = None, own_ordinary: np.ndarray | None = None) -> np.ndarray:
        """log p(word | abusive) - log p(word | ordinary) at each position.

        ``own_abusive`` and ``own_ordinary`` tell the positions that were counted for a class; there it is taken without one document.
        Where abusive text lacks the bigram, the ordinary probability cancels out, so it is worked out for few positions only.
        """
        out = np.zeros(len(ids))
        full = self.abusive[0]
        if not len(ids) or not len(full.bi):
            return out
        last, ctx = contexts(ids, self.size)
        own_abusive = np.zeros(len(ids), bool) if own_abusive is None else own_abusive
        some = np.flatnonzero(full.back2[last] < 1.0)
        last, ctx, w, less = last[some], ctx[some], ids[some].astype(np.int64), own_abusive[some].astype(np.int64)
        ratio = np.stack([x.back2 for x in self.abusive])[less, last]
        at2, in2 = _find(full.bi, last * self.size + w)
        atc, inc = _find(full.ctx, ctx)
        at3, in3 = _find(full.tri, np.where(inc, atc * self.size + w, -1))
        two = np.flatnonzero(in2)
        o = self.ordinary[0].p(ctx[two], w[two])
        if own_ordinary is not None and own_ordinary.any():
            o = np.where(own_ordinary[some][two], self.ordinary[1].p(ctx[two], w[two]), o)
        ratio[two] += np.stack([x.q2 for x in self.abusive])[less[two], at2[two]] / o
        ratio *= np.where(inc, np.stack([x.back3 for x in self.abusive])[less, atc], 1.0)
        ratio[two] += np.where(in3[two], np.stack([x.q3 for x in self.abusive])[less[two], at3[two]], 0.0) / o
        out[some] = np.log(ratio)
        return out

    def scores(self, ids: np.ndarray, *own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per passage (words up to an END): where it ends, and its ratio over its length and ``PAD``."""
        ends = np.flatnonzero(ids == 2)
        if not len(ends):
            return ends, np.zeros(0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sums = np.add.reduceat(self.differences(ids, *own)[: ends[-1] + 1], starts)
        return ends, sums / (ends - starts + 1 + self.PAD)


def picked(ids: np.ndarray, toxic: np.ndarray, models: list[Model], select: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose passage is abusive, and those whose is ordinary, as training text, after each of ``models`` in turn.

    ``toxic`` tells the mark of the document at each position.
    """
    abusive, ordinary = toxic, ~toxic
    for m in models:
        ends, scores = m.scores(ids, abusive, ordinary)
        high = np.repeat(scores > select, np.diff(ends, prepend=-1))
        abusive, ordinary = high & toxic, ~high & ~toxic  # what contradicts the mark is in neither class
    return abusive, ordinary


class Fit:
    """What a task needs to score texts: words and models."""

    def __init__(self, words: Words, model: Model):
        self.words, self.model = words, model

    def passages(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and scores of the passages of all texts, and the text each passage is of."""
        ids = [self.words.encode(t) for t in tokens]
        sizes = np.array([len(i) for i in ids])
        ends, scores = self.model.scores(np.concatenate(ids) if ids else np.zeros(0, np.int64))
        return ends, scores, np.searchsorted(np.cumsum(sizes), ends, side="right")


def _marked_sample(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic) of at most about ``sample`` marked documents, chosen by a hash; even votes are left out."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share < 0.4 or share > 0.6").select("doc_id", (F.col("share") > 0.5).alias("toxic"))
    n = marks.count()
    if n > sample:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    return marks


def _statistics(counted: DataFrame, size: int) -> DataFrame:
    """The rows of a ``Model`` from (ctx, w, t, n), the documents of each class that have a trigram.

    Ordinary counts are kept where abusive text has the bigram or, for sums, its first word, so what
    comes to the driver grows with the abusive passages of the sample and their contexts alone.
    """
    last = F.col("ctx") % size
    c = counted.withColumn("last", last).withColumn("pair", last * size + F.col("w"))
    empty = lambda *xs: [x.cast("long").alias(f"x{i + 1}") for i, x in enumerate([*xs, *[F.lit(0)] * (4 - len(xs))])]
    row = lambda df, kind, k, w, *xs: df.select(F.lit(kind).alias("kind"), k.cast("long").alias("k"), w.cast("long").alias("w"), *empty(*xs))
    zero, x = F.lit(0), F.col
    own, other = c.filter("t > 0"), c.filter("n > 0")
    pairs, lasts = F.broadcast(own.select("pair").distinct()), F.broadcast(own.select("last").distinct())  # of the sample's abusive passages
    twice = F.count(F.when(F.col("n") > 1, 1))
    near = other.join(pairs, "pair", "left_semi")
    sums = other.groupBy("last", "w").agg(F.count(F.lit(1)).alias("c"), twice.alias("c1")).groupBy("last").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("c1").alias("total1"), F.count(F.when(F.col("c1") > 0, 1)).alias("kinds1"))
    per_pair = near.groupBy("pair").agg(F.count(F.lit(1)).alias("c"), twice.alias("c1"))
    per_ctx = other.join(lasts, "last", "left_semi").groupBy("ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), twice.alias("kinds1"))
    pool = c.select("w", "pair").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    parts = [
        row(own, "abusive", x("ctx"), x("w"), x("t")), row(near, "tri", x("ctx"), x("w"), x("n")), row(pool, "pool", x("w"), zero, x("c")),
        row(sums, "uni", x("last"), zero, x("total"), x("kinds"), x("total1"), x("kinds1")), row(per_pair, "bi", x("pair"), zero, x("c"), x("c1")),
        row(per_ctx, "ctx", x("ctx"), zero, x("total"), x("kinds"), x("kinds1")),
    ]
    return reduce(DataFrame.unionByName, parts)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 40_000, rounds: int = 2, sure: float = 3.0, ratio: float = 3.0, select: float = 1.5) -> Fit | None:
    """The models, from at most about ``sample`` marked documents; None if a class has none.

    Counts are of documents, made by Spark over the sample, written as ids of words once. All words and n-grams of the sample count;
    of copies of an abusive document (equal least hash of runs of eight tokens) only one does. For the first
    models an n-gram is abusive if marked documents have it more often than ordinary ones by ``sure``
    deviations and ``ratio`` times; its ordinary counts are then wrong marks. After that, ``rounds`` times, the
    passages that score above ``select`` in marked documents are counted whole, without any such test.
    """
    spark = docs.sparkSession
    marks = _marked_sample(labels, sample)
    fmt = F.col("fmt") if "fmt" in docs.columns else F.lit(None).cast("string").alias("fmt")
    chosen = docs.select("doc_id", "text", fmt).join(F.broadcast(marks), "doc_id")  # at most about `sample` marks

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in batches:
            tokens = [raw_tokens(t if isinstance(t, str) else None, f) for t, f in zip(pdf["text"], pdf["fmt"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "tokens": tokens, "sketch": [sketch(t, cache) for t in tokens]})

    tokens = cut(chosen.mapInPandas(tokenise, "doc_id long, toxic boolean, tokens array<string>, sketch long"))
    by = {r["toxic"]: r["n"] for r in tokens.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by.get(True) or not by.get(False):
        return None

    def words_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + 1000] for b in batches for at in range(0, len(b), 1000)):
            yield pd.DataFrame({"word": [w for t in pdf["tokens"] for w in spoken(set(t) - _ENDS)]}, dtype=object)

    vocabulary = tokens.select("tokens").mapInPandas(words_in, "word string").groupBy("word").count()
    held = sorted((-r["count"], r["word"]) for r in vocabulary.toLocalIterator())  # words of the sample
    words = Words([w for _, w in held])
    size = len(words.names)
    lexicon = spark.sparkContext.broadcast(words)
    first = tokens.filter("toxic").groupBy("sketch").agg(F.min("doc_id").alias("first"))  # a row for each sampled document at most
    flagged = tokens.join(F.broadcast(first), "sketch", "left").select("tokens", "toxic", (~F.col("toxic") | (F.col("doc_id") == F.col("first"))).alias("counts"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "counts": pdf["counts"], "ids": [lexicon.value.encode(list(t)).astype(np.int32) for t in pdf["tokens"]]})

    texts = cut(flagged.mapInPandas(encode, "toxic boolean, counts boolean, ids array<int>"))
    models: list[Model] = []
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast(models)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in (b.iloc[at : at + 1000] for b in batches for at in range(0, len(b), 1000)):
                sizes = np.array([len(i) for i in pdf["ids"]])
                ids = np.concatenate(pdf["ids"].to_list()).astype(np.int64)
                toxic = np.repeat(pdf["toxic"].to_numpy(bool), sizes)
                doc, counts = np.repeat(np.arange(len(pdf)), sizes), np.repeat(pdf["counts"].to_numpy(bool), sizes)
                if not len(ids):
                    continue
                ctx = contexts(ids, size)[1]
                for kind, kept in zip(("t", "n"), picked(ids, toxic, shared.value, select)):
                    at = np.flatnonzero(kept & counts)
                    once = pd.DataFrame({"ctx": ctx[at], "w": ids[at], "doc": doc[at]}).drop_duplicates()
                    n = once.groupby(["ctx", "w"], as_index=False).size()
                    yield pd.DataFrame({"ctx": n["ctx"], "w": n["w"], "t": n["size"] * (kind == "t"), "n": n["size"] * (kind == "n")})

        counted = texts.mapInPandas(count, "ctx long, w int, t long, n long").groupBy("ctx", "w").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        if not k:
            expected = F.col("n") * (by[True] / by[False])
            mine = (F.col("t") - expected > sure * F.sqrt(expected + 1)) & (F.col("t") >= ratio * expected)
            counted = counted.select("ctx", "w", F.when(mine, F.col("t")).otherwise(0).alias("t"), F.when(mine, 0).otherwise(F.col("n")).alias("n"))
        models = [*models, Model(size, _statistics(cut(counted), size).toPandas())]
    return Fit(words, models[-1])


def score(docs: DataFrame, labels: DataFrame, *, sample: int = 40_000, threshold: float = 2.5, **fitting: float) -> DataFrame:
    """(doc_id, source, score, passages, toxic) of every document.

    ``score`` is that of its worst passage, ``passages`` the number above ``threshold`` and ``toxic`` whether
    there is one. Null and empty texts score 0; without marks of both classes all do.
    Every row is scored, also with a repeated id; other columns are ignored.
    """
    fitted = fit(docs, labels, sample=sample, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    pick = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("fmt", "source")]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                best, many = np.zeros(len(pdf)), np.zeros(len(pdf), dtype=np.int64)
                if own is not None:
                    ends, scores, of = own.passages([raw_tokens(t if isinstance(t, str) else None, f) for t, f in zip(pdf["text"], pdf["fmt"])])
                    if len(ends):
                        best = np.full(len(pdf), -np.inf)
                        np.maximum.at(best, of, scores)
                        best[~np.isfinite(best)] = 0.0
                        many = np.bincount(of[scores >= threshold], minlength=len(pdf))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": np.round(best, 6), "passages": many, "toxic": many > 0})

    return docs.select("doc_id", "text", *pick).mapInPandas(scored, "doc_id long, source string, score double, passages long, toxic boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source its documents, those with such a passage, and their share; a null source is one."""
    toxic = F.sum(F.col("toxic").cast("long"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), toxic.alias("toxic_docs"), F.round(toxic / F.count(F.lit(1)), 6).alias("rate"))
