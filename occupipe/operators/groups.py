"""Exact per-group selection that never sorts a whole group in one task.

A window partitioned by a key sorts the key's rows in one task, which fails when one key
holds a third of the data. The operators here place rows by a 64-bit hash instead. They
count rows per (group, hash slice), find the one slice in which a group's k-th row lies,
and rank only that slice. The full rows are then compared with one cutoff per group, so
they are neither sorted nor shuffled when the cutoffs are few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType, UserDefinedType

from occupipe.session import cut_lineage, through_table

SLICES = 1 << 16
LOOKUP_LIMIT = 200_000
LOOKUP_BYTES = 64 << 20


def coin(seed: int, *columns: Column | str) -> Column:
    """A 64-bit hash: the same for a row however the data is partitioned."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(seed))


def md5_coin(seed: int, *columns: Column | str) -> Column:
    """A 60-bit hash that other engines can repeat: the head of an md5 of the values as text."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def md5_coins(key: str | None, places: np.ndarray, seed: int) -> np.ndarray:
    """``md5_coin`` of a key and each of some whole numbers, inside a task."""
    head, tail = b"" if key is None else f"{key}|".encode(), f"|{seed}".encode()
    shown = b"".join([hashlib.md5(b"%b%d%b" % (head, i, tail), usedforsecurity=False).digest() for i in places.tolist()])
    return np.frombuffer(shown, ">u8")[::2].astype(np.uint64) >> np.uint64(4)


def share_below(hashed: Column, share: float | Column) -> Column:
    """Does the hash fall in the given share of the hash range?"""
    return F.pmod(hashed, F.lit(1_000_000)) < F.lit(share) * 1_000_000


def lookup(df: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Mark a side for broadcast if it is counted to have at most ``limit`` rows and ``LOOKUP_BYTES`` bytes.

    Otherwise it is returned as it is, and the join shuffles with AQE splitting skew.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = LOOKUP_LIMIT, limit_bytes: int = LOOKUP_BYTES) -> bool:
    """A full count of rows and bytes: a limit would send its rows from every partition to one task."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")).first()
    return counted["rows"] <= limit and (counted["bytes"] or 0) <= limit_bytes


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: eight a number, and what texts and nested values have when shown."""
    total = F.lit(8)
    for field in df.schema.fields:
        kind, value = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(kind, (ArrayType, MapType, StructType, UserDefinedType)):
            total = total + F.coalesce(F.octet_length(value.cast("string")), F.lit(0))
        else:
            total = total + 8
    return total.cast("bigint")


def derived_lookup(df: DataFrame) -> DataFrame:
    """``lookup`` for an aggregate of large data, which is computed once and written."""
    return lookup(cut_lineage(df))


def lookup_each(
    df: DataFrame, codes: Column, table: DataFrame, on: str, value: str, out: str, limit: int = LOOKUP_LIMIT, apart: bool = False
) -> DataFrame:
    """For an array of codes of any length, the array of their values in a table, in order.

    ``table`` has one row per code in ``on``; a code without a row gives null, a null array
    null and an empty one empty. A table counted to be small, in rows and bytes, goes to every task, where each
    Arrow batch is looked up in one step and nothing is shuffled. A larger one is joined by
    shuffle on the codes; rows are told apart by a number of their own, so repeated rows stay
    apart. Both ways give the same rows. With ``apart`` only the codes go to Python, for rows whose
    other columns are large; those wait in the JVM.
    """
    side = table.filter(F.col(on).isNotNull()).select(F.col(on).alias("_on"), F.col(value).alias("_value"))
    if is_small(side, limit):
        known = side.toArrow()
        shared = df.sparkSession.sparkContext.broadcast((known.column("_on").combine_chunks(), known.column("_value").combine_chunks()))

        names, kind = df.columns, ArrayType(side.schema["_value"].dataType)

        def values_of(asked: pa.Array) -> pa.Array:
            keys, values = shared.value
            at = pc.index_in(asked.flatten().cast(keys.type), value_set=keys, skip_nulls=True)
            sizes = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            return pa.ListArray.from_arrays(ends, values.take(at), mask=pc.is_null(asked))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = values_of(batch.column(len(names)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], names=[*names, out])

        if apart:
            # What Spark takes for random is run once and not again in a filter on what is made of it.
            return df.withColumn(out, F.arrow_udf(values_of, kind).asNondeterministic()(codes))
        return df.withColumn("_codes", codes).mapInArrow(probe, StructType([*df.schema.fields, StructField(out, kind)]))
    numbered = through_table(df.withColumn("_codes", codes).withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select("_row", F.posexplode("_codes").alias("_at", "_code"))
    joined = rows.join(side, F.col("_code") == F.col("_on"), "left")
    ranked = F.array_sort(F.collect_list(F.struct("_at", F.struct("_value").alias("_v"))))
    grouped = joined.groupBy("_row").agg(F.transform(ranked, lambda e: e["_v"]["_value"]).alias(out))
    # A row without codes is not among the groups.
    empty = F.when(F.size("_codes") == 0, F.slice(F.array(F.lit(None).cast(dict(side.dtypes)["_value"])), 1, 0))
    rejoined = numbered.join(grouped, "_row", "left")
    return rejoined.select(*df.columns, F.coalesce(out, empty).alias(out))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(1)), ["_all"]


def first_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    take: Column,
    seed: int,
    flag: str = "taken",
    slices: int = SLICES,
) -> DataFrame:
    """Flag the first ``take`` rows of each group in hash order.

    ``take`` is an expression over the group size ``n``. ``ids`` must tell rows apart.
    Rows with a null key form a group of their own.
    """
    data, keys = _keyed(df, keys)
    data = data.withColumn("_h", coin(seed, *ids))
    # The slice number keeps hash order, so slices can be added up from the left.
    data = data.withColumn("_s", F.floor((F.col("_h") / 2.0**64 + 0.5) * slices).cast("int"))
    counts = data.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("_upto", F.sum("_c").over(running))
        .withColumn("n", F.sum("_c").over(per_key))
        .withColumn("_take", take.cast("long"))
    )
    # The slice in which the last taken row lies, and that row's rank within it.
    border = placed.filter(
        (F.col("_take") > F.col("_upto") - F.col("_c")) & (F.col("_take") <= F.col("_upto"))
    ).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_s").alias("_k_s"),
        (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_need"),
    )
    border = derived_lookup(border)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    row_id = F.struct(*ids)
    narrow = data.select(*keys, "_s", "_h", row_id.alias("_id"))
    in_border = narrow.join(border, same & (F.col("_s") == F.col("_k_s")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "_id"))
    cutoffs = (
        in_border.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.struct(F.col("_h"), F.col("_id")).alias("_cut"),
        )
    )
    # Groups that take nothing have no cutoff and stay unflagged.
    joined = data.join(derived_lookup(cutoffs), same, "left")
    here = F.struct(F.col("_h"), row_id.alias("_id"))
    return joined.select(
        *df.columns, F.coalesce(here <= F.col("_cut"), F.lit(False)).alias(flag)
    )


def keep_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """One row per key, first in a total order.

    The rank filter is applied within each map task first, so a frequent key sends one
    row per task rather than all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in a total order, limited in the map tasks first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Sort the whole frame and number its rows from 0.

    The sort is a range shuffle. Its result is written once, so that the partition counts
    and the rows come from the same data even if an executor is lost between the two.
    """
    placed = cut_lineage(
        df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    # The id holds the partition above bit 33 and the position in it below.
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")
    )
    at = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_from") + at).alias(name))
    )
