"""Test passages in documents, by pigeonhole edit matching over words.

A document carries a passage if some ``window`` running words of an item stand in it with at
most ``errors`` words replaced, dropped or added. Split into ``errors + 1`` pieces, such a window
keeps a piece whole, so it shares ``window // (errors + 1)`` running words with the document:
all item grams of that length are the index, every document's words are looked up in it,
and each hit is verified with Myers' bit-parallel distance of the windows around it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.llm.text import plain_words, readable, unmarked
from levelweave.plans.storage import cut

_SENTENCE = re.compile(r"[^.!?。！？:]*[.!?。！？:]?")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str | None) -> list[str]:
    """The sentences of an item as their plain words, in order."""
    return [" ".join(plain_words(unmarked(x))) for x in _SENTENCE.findall(text or "")]


def runs_between(parts: list[str], shared: set[str]) -> list[list[str]]:
    """Runs of words of an item, cut at the ``shared`` sentences."""
    runs: list[list[str]] = [[]]
    for s in parts:
        if s and s in shared:
            runs.append([])
        else:
            runs[-1] += s.split()
    return [r for r in runs if r]


def document_words(text: str | None, fmt: str | None) -> list[list[str]]:
    """Plain words of a document's sources and of its outputs."""
    return [plain_words(unmarked(part)) for part in readable(text, fmt) if part]


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` ids from each position on."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size):
        h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(k + 1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def distance_within(pattern: list[int], text: np.ndarray, errors: int) -> bool:
    """Whether a part of ``text`` is within ``errors`` edits of ``pattern`` (Myers 1999, search form)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        peq[w] |= 1 << k
    pv, mv, score = full, 0, m
    for w in text.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        if score <= errors:
            return True
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return False


class Index:
    """The grams of a block of items; word ids are the block's own vocabulary, -1 is any other word."""

    def __init__(self, items: dict[int, list[list[str]]], window: int, errors: int):
        self.window, self.errors, self.size = window, errors, window // (errors + 1)
        self.ids: dict[str, int] = {}
        self.runs: list[tuple[int, np.ndarray]] = []
        hashes, runs, at = [], [], []
        for item, parts in items.items():
            for words in parts:
                if len(words) < window:
                    continue
                ids = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int64)
                h = _grams(ids, self.size)
                hashes.append(h)
                runs.append(np.full(len(h), len(self.runs)))
                at.append(np.arange(len(h)))
                self.runs.append((item, ids))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.run = np.concatenate(runs)[order] if runs else np.zeros(0, int)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, int)

    def find(self, parts: list[list[str]]) -> set[int]:
        """Items of which one of the parts of a document carries a window."""
        found: set[int] = set()
        get = self.ids.get
        for part in parts:
            words = np.fromiter((get(w, -1) for w in part), dtype=np.int64, count=len(part))
            if len(words) < self.window - self.errors:
                continue
            known = np.concatenate([[0], np.cumsum(words >= 0)])
            starts = np.flatnonzero(known[self.size :] - known[: -self.size] == self.size)
            if not len(starts):
                continue
            h = _grams(words, self.size)[starts]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            hits: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
            for p, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist()):
                for k in range(a, b):
                    hits[int(self.run[k])][int(self.at[k]) - p].add(p)
            for run, diagonals in hits.items():
                if self.runs[run][0] not in found and self._verified(run, diagonals, words):
                    found.add(self.runs[run][0])
        return found

    def _verified(self, run: int, diagonals: dict[int, set[int]], words: np.ndarray) -> bool:
        item = self.runs[run][1]
        last = len(item) - self.window
        tried: set[tuple[int, int]] = set()
        for shift, places in sorted(diagonals.items(), key=lambda d: -len(d[1])):
            for p in sorted(places):
                q = p + shift
                first, stop = max(0, q + self.size - self.window), min(last, q) + 1
                near = set(words[max(0, first - shift - self.errors) : stop - 1 - shift + self.window + self.errors].tolist())
                present = np.concatenate([[0], np.cumsum([w in near for w in item[first : stop - 1 + self.window].tolist()])])
                enough = present[self.window :] - present[: len(present) - self.window] >= self.window - self.errors
                for j in (first + np.flatnonzero(enough)).tolist():  # a window lacking more words than the budget can't match
                    begin = j - shift - self.errors
                    if (j, begin) not in tried:
                        tried.add((j, begin))
                        end = begin + self.window + 2 * self.errors
                        if distance_within(item[j : j + self.window].tolist(), words[max(0, begin) : max(0, end)], self.errors):
                            return True
        return False


def _marked_sentences(items: DataFrame, shared_by: int) -> DataFrame:
    """(own, item_id, at, sentence, shared, words) of all sentences; ``shared`` ones stand in ``shared_by`` items or more, of all blocks."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(o, i, k, s, s.count(" ") + 1) for o, i, t in zip(pdf["own"], pdf["item_id"], pdf["text"]) for k, s in enumerate(sentences(t if isinstance(t, str) else None)) if s]
            yield pd.DataFrame(rows, columns=["own", "item_id", "at", "sentence", "words"])

    rows = items.filter(F.col("item_id").isNotNull()).select(F.monotonically_increasing_id().alias("own"), F.col("item_id").cast("long").alias("item_id"), "text")
    every = cut(rows.mapInPandas(split, "own long, item_id long, at int, sentence string, words int"))
    many = every.groupBy("sentence").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= shared_by).select("sentence", F.lit(True).alias("shared"))
    return cut(every.join(many, "sentence", "left").withColumn("shared", F.coalesce("shared", F.lit(False))))


def leaked(docs: DataFrame, items: DataFrame, *, window: int = 20, errors: int = 2, shared_by: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) for every document that carries ``window`` running words of an item.

    Items are a stated query set: they are taken in blocks of about ``block_words`` words, of which the index is sent
    to the tasks; every document is searched whole against every block, without a shuffle. Documents are
    parsed once: with several blocks, their words are written first. Sentences are shared if ``shared_by`` items of all blocks have them.
    Null and empty texts carry nothing; items of fewer than ``window`` words without their
    shared sentences cannot be carried; repeated ids give one row.
    """
    spark = docs.sparkSession
    marked = _marked_sentences(items, shared_by)
    blocks = max(1, math.ceil((marked.agg(F.sum("words")).first()[0] or 0) / block_words))
    slim = docs.select("doc_id", "text", F.col("fmt") if "fmt" in docs.columns else F.lit(None).cast("string").alias("fmt"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "parts": [document_words(t if isinstance(t, str) else None, f) for t, f in zip(pdf["text"], pdf["fmt"])]})

    parsed = cut(slim.mapInPandas(parse, "doc_id long, parts array<array<string>>")) if blocks > 1 else None
    out = None
    for b in range(blocks):
        part = marked.filter(F.pmod(F.xxhash64("own"), F.lit(blocks)) == b).toPandas().sort_values(["own", "at"])
        texts: dict[int, list[list[str]]] = defaultdict(list)
        for (_, item), rows in part.groupby(["own", "item_id"]):
            texts[int(item)] += runs_between(rows["sentence"].tolist(), set(rows["sentence"][rows["shared"]]))
        index = spark.sparkContext.broadcast(Index(texts, window, errors))

        def search(batches: Iterator[pd.DataFrame], index=index, whole=parsed is None) -> Iterator[pd.DataFrame]:
            own = index.value
            for pdf in batches:
                texts = (document_words(t if isinstance(t, str) else None, f) for t, f in zip(pdf["text"], pdf["fmt"])) if whole else ([p.tolist() for p in parts] for parts in pdf["parts"])
                rows = [(d, i) for d, parts in zip(pdf["doc_id"], texts) for i in sorted(own.find(parts))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype({"item_id": "int64"})

        found = (slim if parsed is None else parsed).mapInPandas(search, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
