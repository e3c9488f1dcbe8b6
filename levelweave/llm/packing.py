"""Texts of varying token length into containers of fixed capacity, first-fit decreasing.

Items are dealt into randomised groups of bounded size; each group is packed on its own, with a
tournament tree over the free room of its containers that finds the first one with enough room
in logarithmic time. Only the last containers of a group stay partly empty, so the loss against
packing all items at once is a few containers in each group of thousands.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelweave.plans.storage import cut

TOKENIZERS = "/opt/tokenizers"


# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str, ranks: str = "byte_bpe_50k.tiktoken"):
    """A public byte-level BPE from its rank file; loaded once in each Python worker."""
    import tiktoken

    with open(f"{folder}/{ranks}", "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def count_tokens(text: str | None, enc) -> int:
    """Tokens of the whole text, however long."""
    return len(enc.encode_ordinary(text)) if text else 0


def token_counts(text: Column, folder: str = TOKENIZERS) -> Column:
    """Tokens of each text; null and empty texts have none."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(folder)
        for texts in batches:
            yield pd.Series([count_tokens(t if isinstance(t, str) else None, enc) for t in texts], dtype="int64")

    return counted(text)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items taken by falling size (ties in the order given).

    ``room`` is a tournament tree: leaf k holds the room of container k, every inner node the
    greater room below it; going left wherever that is enough finds the first fit.
    """
    n = len(sizes)
    leaves = 1 << max(1, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    place = np.empty(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, k = int(sizes[i]), 1
        while k < leaves:
            k *= 2
            if room[k] < need:
                k += 1
        place[i] = k - leaves
        room[k] -= need
        k //= 2
        while k:
            most = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == most:
                break
            room[k] = most
            k //= 2
    return place


def pack(docs: DataFrame, *, capacity: int = 8192, group_items: int = 10_000, tokenizers: str = TOKENIZERS, seed: int = 5) -> DataFrame:
    """A container and a place in it for every text of ``docs``.

    One row per item: ``doc_id``, ``piece`` (0, or the number of the piece of a text longer than
    ``capacity``), ``pieces``, ``tokens``, ``container``, ``place`` (order in the container) and
    ``offset`` (tokens before it). Only texts longer than ``capacity`` are split, into full pieces
    and a rest. Null and empty texts are items of no tokens. Every row is an item, also with a
    repeated or null ``doc_id``; other columns are ignored; an empty table packs to nothing.
    """
    sized = docs.select("doc_id", token_counts(F.col("text"), tokenizers).alias("total"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int")
    items = sized.withColumn("pieces", pieces).select("doc_id", "total", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    items = cut(items.select("doc_id", "piece", "pieces", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece").cast("long") * capacity).alias("tokens")))
    groups = max(1, math.ceil(items.count() / group_items))
    same = items.groupBy("doc_id", "piece", "pieces", "tokens").agg(F.count(F.lit(1)).alias("n"))  # rows alike are dealt by number, so that no file layout matters
    step = 100_000
    many = same.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    each = many.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + step) - 1))).drop("n", "from")
    dealt = each.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "tokens", "copy", F.lit(seed)), F.lit(groups)).cast("int")).drop("copy")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        pdf["container"] = first_fit_decreasing(pdf["tokens"].to_numpy(), capacity)
        by = pdf.groupby("container", sort=False)
        pdf["place"] = by.cumcount().astype("int32")
        pdf["offset"] = by["tokens"].cumsum() - pdf["tokens"]
        pdf["container"] += int(key[0]) << 32
        return pdf[["doc_id", "piece", "pieces", "tokens", "container", "place", "offset"]]

    return dealt.groupBy("group").applyInPandas(packed, "doc_id long, piece int, pieces int, tokens long, container long, place int, offset long")


def container_fill(packed: DataFrame) -> DataFrame:
    """Per container its items and tokens."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
