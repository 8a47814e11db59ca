"""Samples and splits that do not depend on how the data is partitioned.

Rows are placed by a hash of their id and a seed, so the same rows are drawn on any
cluster and after any retry. Sampled rows differ from those a pandas seed draws; the
rules and sizes are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.operators.groups import (
    derived_lookup,
    first_by_hash,
    lookup,
    md5_coin,
    share_below,
    with_row_index,
)
from occupipe.session import through_table


def sample_share(df: DataFrame, ids: Sequence[str], share: float, seed: int = 1) -> DataFrame:
    return df.filter(share_below(md5_coin(seed, *ids), share))


def sample_share_per_group(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], share: float, seed: int = 1
) -> DataFrame:
    """``round(share * n)`` rows of each group, ties of the rounding to even."""
    flagged = first_by_hash(df, keys, ids, F.bround(F.col("n") * share), seed)
    return flagged.filter("taken").drop("taken")


def random_split(df: DataFrame, ids: Sequence[str], train: float = 0.8, seed: int = 2021) -> DataFrame:
    """Add ``split``: train or test, by hash."""
    return df.withColumn("split", F.when(share_below(md5_coin(seed, *ids), train), "train").otherwise("test"))


def stratified_split(
    df: DataFrame,
    row_id: str,
    code: str,
    title: str,
    train: float = 0.8,
    seed: int = 2021,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split``: train or test, by code.

    Rows with a null id are definitions and go to train. A code's size is its number of
    titled ads: codes of size one go to train, codes of size zero leave both sides, and
    larger ones give ``floor(train * n)`` of their ads, at least one, to train.
    """
    ids = list(ids or [row_id])
    real = df.filter(F.col(row_id).isNotNull())
    sizes = derived_lookup(real.groupBy(code).agg(F.count(title).alias("_size")))
    sized = real.join(sizes, code)
    flagged = first_by_hash(
        sized.filter(F.col("_size") > 1), [code], ids, F.greatest(F.lit(1), F.floor(F.col("n") * train)), seed
    )
    many = flagged.withColumn("split", F.when(F.col("taken"), "train").otherwise("test"))
    once = sized.filter(F.col("_size") == 1).withColumn("split", F.lit("train"))
    definitions = df.filter(F.col(row_id).isNull()).withColumn("split", F.lit("train"))
    columns = [*df.columns, "split"]
    return definitions.select(columns).unionByName(once.select(columns)).unionByName(many.select(columns))


def holdout_of_repeats(
    df: DataFrame, code: str, row_id: str, size: int, seed: int = 1
) -> DataFrame:
    """Add ``split``; test holds exactly ``size`` rows, none the first of its code."""
    firsts = derived_lookup(df.groupBy(code).agg(F.min(row_id).alias("_first")))
    marked = df.join(firsts, code).withColumn("_repeat", F.col(row_id) != F.col("_first"))
    chosen = first_by_hash(marked.filter("_repeat"), [], [row_id], F.least(F.lit(size), F.col("n")), seed)
    test = chosen.filter("taken").select(row_id)
    return df.join(derived_lookup(test.withColumn("_test", F.lit(True))), row_id, "left").select(
        *df.columns, F.when(F.col("_test"), "test").otherwise("train").alias("split")
    )


def exact_split(
    df: DataFrame, ids: Sequence[str], train_size: int, fraction: float, seed: int = 1
) -> DataFrame:
    """Exactly ``train_size`` train and ``int(fraction * train_size)`` test rows."""
    test_size = int(fraction * train_size)
    both = first_by_hash(df, [], ids, F.least(F.lit(train_size + test_size), F.col("n")), seed)
    both = both.filter("taken").drop("taken")
    flagged = first_by_hash(both, [], ids, F.least(F.lit(train_size), F.col("n")), seed)
    return flagged.withColumn("split", F.when(F.col("taken"), "train").otherwise("test")).drop("taken")


def head_split(df: DataFrame, order: str, percent: int = 5) -> DataFrame:
    """Add ``split``: the first percent of rows in order, and no more, is validation.

    Only the order column is sorted, with a number of each row's own that settles ties; the
    rows are compared with the one cutoff. The rows are written once, so that the numbers stay.
    """
    numbered = through_table(df.withColumn("_row", F.monotonically_increasing_id()))
    ordered = with_row_index(numbered.select(order, "_row"), [F.asc(order), F.asc("_row")])
    size = ordered.count() * percent // 100
    if size == 0:
        return df.withColumn("split", F.lit("train"))
    cutoff = ordered.filter(F.col("row_index") == size - 1).first()
    value = F.lit(cutoff[order]).cast(dict(df.dtypes)[order])
    before = F.col(order).isNull() if cutoff[order] is not None else F.lit(False)
    tie = F.col(order).eqNullSafe(value) & (F.col("_row") <= cutoff["_row"])
    first = F.coalesce(F.col(order) < value, before) | tie
    return numbered.withColumn("split", F.when(first, "validation").otherwise("train")).drop("_row")


def split_audit(df: DataFrame, code: str) -> DataFrame:
    """Codes per side, and test codes that train lacks."""
    in_train = F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("_train")
    in_test = F.max(F.when(F.col("split") == "test", 1).otherwise(0)).alias("_test")
    per_code = df.groupBy(code).agg(in_train, in_test)
    return per_code.agg(
        F.sum("_train").alias("train_codes"),
        F.sum("_test").alias("test_codes"),
        F.count_if((F.col("_test") == 1) & (F.col("_train") == 0)).alias("missing_from_train"),
    )


def sample_with_replacement(df: DataFrame, row_id: str, k: int, seed: int = 1) -> DataFrame:
    """``k`` draws: column ``draw`` plus the drawn row."""
    numbered = with_row_index(df.select(row_id), [F.asc(row_id)], "_at")
    n = numbered.count()
    draws = df.sparkSession.range(k).select(
        F.col("id").alias("draw"), F.pmod(md5_coin(seed, "id"), F.lit(max(n, 1))).alias("_at")
    )
    drawn = numbered.join(lookup(draws), "_at").select("draw", row_id)
    return df.join(derived_lookup(drawn), row_id).select("draw", *df.columns)
