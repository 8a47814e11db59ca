"""File sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.operators.corpus import one_line
from occupipe.session import unsorted_writes


def write_buckets(df: DataFrame, path: str, bucket: str = "bucket", append: bool = False) -> None:
    """CSV by bucket. Buckets present in the frame are replaced, or appended to.

    Rows are brought together by bucket first, since otherwise every task would write a
    file into every bucket. The rebalance joins small buckets into one task and splits a
    bucket that holds much of the data over several.
    """
    writer = df.hint("rebalance", bucket).write.partitionBy(bucket).option("header", True).option("escape", '"')
    if append:
        writer.mode("append").csv(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(path)


def write_lines(df: DataFrame, path: str, text: str) -> None:
    """One cleaned document per line."""
    df.select(one_line(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def write_nested(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_with_quarantine(df: DataFrame, path: str, reason: str = "reject_reason") -> None:
    """Write accepted and rejected rows of one tagged frame below ``rejected=false`` and ``rejected=true``.

    One write, so the input is parsed once and a failed job leaves neither half behind.
    """
    with unsorted_writes(df.sparkSession):
        df.withColumn("rejected", F.col(reason).isNotNull()).write.mode("append").partitionBy("rejected").parquet(path)


def stamped(df: DataFrame, column: str = "processed_at") -> DataFrame:
    """Add the time of the job: one value for all rows."""
    return df.withColumn(column, F.current_timestamp())


def process_bucket(df: DataFrame, text: str, cleaned: Column, path: str, bucket: str = "bucket") -> None:
    """Read, clean and write buckets in one job."""
    write_buckets(stamped(df.withColumn(text, cleaned)), path, bucket)
