"""Joins by code, key and crosswalk.

The taxonomy side is broadcast only after a count shows that it is small; see
``groups.lookup``. A larger side joins by shuffle, where AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.functions import codes as K
from occupipe.functions import text as T
from occupipe.operators.groups import derived_lookup, is_small, keep_one, lookup, lookup_each

COPIES = 4096


def with_counts(taxonomy: DataFrame, code: str, counts: DataFrame, count: str = "n") -> DataFrame:
    """Every taxonomy row with its count, 0 where it has none."""
    joined = taxonomy.join(counts, code, "left")
    return joined.withColumn(count, F.coalesce(count, F.lit(0)))


def with_availability(df: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Flag rows whose key occurs in either of two tables."""
    a = first.select(F.col(key), F.lit(True).alias("_a")).distinct()
    b = second.select(F.col(key), F.lit(True).alias("_b")).distinct()
    return (
        df.join(a, key, "left")
        .join(b, key, "left")
        .withColumn("available", F.col("_a").isNotNull() | F.col("_b").isNotNull())
        .drop("_a", "_b")
    )


def by_record_key(df: DataFrame, plain_id: str, records: DataFrame, key: str = "uuid") -> DataFrame:
    """Left join on the hash of a plain id."""
    return df.withColumn(key, T.record_key(F.col(plain_id))).join(records, key, "left")


def with_titles(df: DataFrame, columns: Sequence[str], taxonomy: DataFrame) -> DataFrame:
    """Add ``<column>_title`` for each code column, from one taxonomy table.

    A code listed several times gives a row for each of its titles. Lists of titles are joined
    and spread last, so no join meets the rows that another one has made.
    """
    lists = derived_lookup(_title_lists(taxonomy))
    for column in columns:
        side = lists.select(F.col("code").alias("_code"), F.col("_titles").alias(f"_{column}_titles"))
        df = df.join(side, F.col(column) == F.col("_code"), "left").drop("_code")
    for column in columns:
        spread = df.withColumn("_title", F.explode_outer(f"_{column}_titles"))
        df = spread.withColumn(f"{column}_title", F.col("_title.title")).drop("_title", f"_{column}_titles")
    return df


def _title_lists(taxonomy: DataFrame) -> DataFrame:
    """The titles of each code, nulls included, in lists of about ``COPIES`` at most."""
    titles = _counted(taxonomy.filter(F.col("code").isNotNull()).select("code", "title"), "_n")
    runs = titles.groupBy("code").agg(F.floor((F.sum("_n") - 1) / COPIES + 1).alias("_runs"))
    rows = _repeated(titles.join(runs, "code"), F.col("_n"))
    # Repeats of a title are told apart by their number, so that they spread as well.
    run = F.pmod(F.xxhash64("title", "_copy"), F.col("_runs"))
    return rows.groupBy("code", run.alias("_list")).agg(F.collect_list(F.struct("title")).alias("_titles")).drop("_list")


def crosswalk(df: DataFrame, code: str, table: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Recode by a crosswalk; a code with several targets gives several rows."""
    side = table.select(F.col(source).alias("_source"), F.col(target).alias(out))
    return df.join(lookup(side), F.col(code) == F.col("_source"), "left").drop("_source")


def crosswalk_first(df: DataFrame, code: str, table: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Recode by a crosswalk's first target in code order."""
    first = table.groupBy(source).agg(F.min(target).alias(target))
    return crosswalk(df, code, first, source, target, out)


def recode_twice(
    df: DataFrame, code: str, aliases: DataFrame, versions: DataFrame, deleted: str = "Deleted"
) -> DataFrame:
    """Alias to actual code, then old to new version; rows with no live code are dropped.

    ``aliases`` has (alias, actual), ``versions`` has (old, new). Links listed several times are
    joined once, and each of their rows is repeated last, so no join meets repeated rows.
    """
    actual = _counted(aliases.select(F.col("alias").alias("_alias"), F.col("actual").alias("_actual")).dropna(), "_n")
    live = versions.select(F.col("old").alias("_old"), F.col("new").alias(code)).dropna().filter(F.col(code) != deleted)
    step = df.join(derived_lookup(actual), F.col(code) == F.col("_alias")).drop(code, "_alias")
    step = step.join(derived_lookup(_counted(live, "_m")), F.col("_actual") == F.col("_old")).drop("_actual", "_old")
    return _repeated(step, F.col("_n") * F.col("_m")).select(*[c for c in df.columns if c != code], code)


def _counted(df: DataFrame, count: str) -> DataFrame:
    """Each distinct row once, and how often it occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def _repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, once at least, numbered by ``_copy`` from 0.

    By lists of at most ``COPIES`` numbers, and one for each such list.
    """
    lists = F.sequence(F.lit(0), F.floor((times - 1) / COPIES))
    # An inner explode would make each list again in a filter on its size.
    runs = df.withColumn("_copies", times).withColumn("_run", F.explode_outer(lists))
    first = F.col("_run") * COPIES
    last = F.least(first + (COPIES - 1), F.col("_copies") - 1)
    return runs.withColumn("_copy", F.explode_outer(F.sequence(first, last))).drop("_copies", "_run")


def only_in(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    return df.join(table.select(key), key, "left_semi")


def not_in(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    return df.join(table.select(key), key, "left_anti")


def apply_tags(rows: DataFrame, row_id: str, tags: DataFrame, label: str) -> DataFrame:
    """Label rows by a tag document: JSON text ``{code: [row ids]}`` in column ``tags``.

    A row tagged twice comes out twice, once per code.
    """
    parsed = F.from_json("tags", "map<string,array<bigint>>")
    pairs = tags.select(F.explode(parsed).alias(label, "_ids")).select(label, F.explode("_ids").alias(row_id))
    return rows.drop(label).join(pairs, row_id)


def expand_classes(df: DataFrame, code: str, classes: Sequence[str]) -> DataFrame:
    """One row per row and class, with a label for the row's own class.

    The class list is a literal of fixed length, so this is a narrow stage.
    """
    values = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("class", F.explode(values)).withColumn(
        "label", (F.col("class") == K.level(F.col(code), 1)).cast("int")
    )


def by_row_id(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns of two frames side by side, matched by an explicit row id."""
    return left.join(right, row_id, "full")


def similarity_of(
    df: DataFrame, key: str, label: str, predicted: str, matrix: DataFrame
) -> DataFrame:
    """Inverse similarity of each (label, predicted) pair, as an array in rank order.

    ``matrix`` is long: code_a, code_b, sim. A missing pair gives null, one listed several times
    its first value if the matrix is small enough for every task, and all its values if not. Then
    a row meets its label's part of the matrix as one row, so no pair is joined.
    """
    pair = lambda a, b: F.concat_ws("|", a, b)
    listed = matrix.select(pair("code_a", "code_b").alias("_pair"), (1 - F.col("sim")).alias("_cost"))
    if is_small(listed):
        asked = F.transform(predicted, lambda code: pair(F.col(label), code))
        return lookup_each(df.select(key, label, predicted), asked, listed, "_pair", "_cost", "costs").select(key, label, "costs")
    cost = F.sort_array(F.collect_list(F.struct((1 - F.col("sim")).alias("c"))))["c"]
    pairs = matrix.filter(F.col("code_a").isNotNull() & F.col("code_b").isNotNull()).groupBy("code_a", "code_b").agg(cost.alias("c"))
    own = pairs.groupBy(F.col("code_a").alias("_a")).agg(F.map_from_entries(F.collect_list(F.struct("code_b", "c"))).alias("_of"))
    joined = df.select(key, label, predicted).join(derived_lookup(own), F.col(label) == F.col("_a"), "left")
    none = F.array(F.lit(None).cast(pairs.schema["c"].dataType.elementType))
    found = F.transform(predicted, lambda code: F.coalesce(F.try_element_at("_of", code), none))
    return joined.select(key, label, F.flatten(found).alias("costs"))


def matrix_to_long(matrix: DataFrame, row_label: str) -> DataFrame:
    """A square matrix with labelled rows and columns as (code_a, code_b, sim)."""
    columns = [c for c in matrix.columns if c != row_label]
    return matrix.unpivot([row_label], columns, "code_b", "sim").withColumnRenamed(row_label, "code_a")


def first_crosswalk_rows(table: DataFrame, source: str, order: Sequence[Column]) -> DataFrame:
    """Whole crosswalk rows, one per source, in a given order."""
    return keep_one(table, [source], order)
