"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that the table has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts are long, so Arrow batches hold fewer rows and bytes than the defaults."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    # A batch ends with the row that takes it over this size, so one row may be larger.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ddl(df: DataFrame, *names: str) -> str:
    """The columns' names and types as a schema string."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def never_sent(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted, never broadcast.

    Spark goes by the bytes of files and shuffles, compressed and before lists are exploded. What the
    driver would hold to broadcast it can be a hundred times that.
    """
    return df.hint("merge")


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for later tasks, whose peaks would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def keyed_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone, whatever else the table holds; null text is empty."""
    return docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def splitmix(seed: int, n: int) -> list[int]:
    """``n`` well-mixed unsigned 64-bit numbers (splitmix64)."""
    out, mask = [], (1 << 64) - 1
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


SPACE = re.compile(r"\s+")
