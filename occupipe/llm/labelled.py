"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import col


def labelled_sample(labels: DataFrame, usable: Column, label: str, limit: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """``limit`` ids at most with their labels, drawn by a hash of the id from the usable rows.

    Rows without an id or a label are left out; an id with several labels takes the largest.
    """
    coin = F.xxhash64("_id", F.lit(seed))
    rows = labels.select(col(doc_id).alias("_id"), col(label).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isNotNull()
    )
    rows = rows.filter(usable)
    # The share is set from a count, so that no task sorts more than about the limit.
    n = rows.count()
    share = min(1.0, 1.2 * limit / max(1, n))
    drawn = rows.filter(F.pmod(coin, F.lit(1_000_000)) < share * 1_000_000)
    return drawn.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(limit)
