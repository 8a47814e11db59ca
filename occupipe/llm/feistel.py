"""Reproducible shuffle and sharding by a Feistel permutation (operator 8).

Rows are numbered in the order of (id, checksum, size). A balanced Feistel network permutes
the smallest power of four that holds all numbers; a number that lands outside is permuted
again until it lands inside (cycle walking), which keeps the map one to one on the rows. The
permuted number p gives shard ``p % shards`` and slot ``p // shards``, so shard sizes differ by
one at most, slots have no gaps, and both can be computed, and inverted, from the row number.

Defined results: a null text has no bytes; ids may be null or repeated (such rows are numbered
next to each other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import col, splitmix
from occupipe.operators.groups import with_row_index
from occupipe.session import through_table

ROUNDS = 6


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    z = half ^ np.uint64(key)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return z ^ (z >> np.uint64(32))


def permuted(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Where the numbers 0 to n-1 go under the permutation of that seed; or whence they came."""
    if n < 2:
        return np.asarray(numbers, np.int64)
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = splitmix(seed, ROUNDS)
    x = np.asarray(numbers).astype(np.uint64)
    outside = np.ones(len(x), bool)
    while outside.any():
        y = x[outside]
        left, right = y >> shift, y & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & mask)
        x[outside] = (left << shift) | right
        outside = x >= np.uint64(n)
    return x.astype(np.int64)


def permutation(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def walk(rows: pd.Series) -> pd.Series:
        return pd.Series(permuted(rows.to_numpy(), n, seed))

    return walk(number)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row_number``, ``place``, ``shard`` and ``slot``.

    Texts are read once and never shuffled; what is sorted holds an id and two numbers a row.
    """
    whole = F.coalesce(col(text), F.lit(""))
    narrow = through_table(
        docs.select(
            col(doc_id).alias("doc_id"),
            (F.octet_length(whole).cast("long") + 8).alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
        )
    )
    n = narrow.count()
    order = [F.asc("doc_id"), F.asc("text_crc32"), F.asc("size")]
    numbered = with_row_index(narrow, order, "row_number")
    placed = numbered.withColumn("place", permutation(F.col("row_number"), n, seed))
    return placed.withColumns(
        {"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("long")}
    )
