"""Structured Streaming forms. The column functions are those of the batch jobs.

``trigger(availableNow=True)`` processes what has arrived and stops, which is a scheduled
incremental run; the checkpoint remembers what has been read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from occupipe.functions import text as T
from occupipe.operators.groups import keep_one
from occupipe.operators.joins import with_titles
from occupipe.session import cut_lineage, held_table, unsorted_writes
from occupipe.sources import records
from occupipe.sources.readers import file_id

ID_SLOTS = 256


def read_record_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON files as raw documents with the id from the file name."""
    reader = spark.readStream.schema("value string").option("wholetext", True)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger).format("text")
    return reader.load(path).select(file_id().alias("ad_id"), F.col("value").alias("doc"))


def flatten_stream(documents: DataFrame) -> DataFrame:
    """Flatten and clean; stateless."""
    flat = records.flatten(records.parse_records(documents))
    return flat.withColumn("description", T.clean_final(T.clean_raw(F.col("description"))))


def skip_repeats(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop ids seen within the watermark delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_unseen(
    stream: DataFrame, key: str, path: str, checkpoint: str, bucket: str = "bucket", order: Sequence[str] = (), slots: int = ID_SLOTS
) -> StreamingQuery:
    """Append rows whose id the sink does not hold, however long ago it was written.

    Ids are kept beside the rows in ``{path}/ids``, by ``slots`` hash slots, and a micro-batch reads only
    the slots of its own ids; the rows are in ``{path}/rows``, see ``appended``. Of several rows of
    an id in a batch the first by ``order`` and then by all columns stays. Each batch of a
    checkpoint writes folders of its own, which a retry overwrites, and a retry does not take the
    ids of its failed attempt for known. So nothing is written twice and nothing is lost.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    first = [F.col(c) for c in (*order, *sorted(c for c in stream.columns if c not in order))]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
        fresh = keep_one(batch.withColumn("slot", slot), [key], first)
        ids, here = f"{path}/ids", f"run={run}/batch={number}"
        if folder_exists(spark, ids):
            mine = [r["slot"] for r in batch.select(slot.alias("slot")).distinct().collect()]  # at most ``slots`` numbers
            done = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, run string, batch bigint, slot int").parquet(ids)
            earlier = (F.col("run") != run) | (F.col("batch") < number)
            known = done.filter(F.col("slot").isin(mine) & earlier).select(F.col(key).alias("_known"))
            fresh = fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        fresh = cut_lineage(fresh)
        fresh.drop("slot").write.mode("overwrite").partitionBy(bucket).parquet(f"{path}/rows/{here}")
        # The rows are whole before their ids are known.
        fresh.select(key, "slot").repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{ids}/{here}")

    return start(stream.writeStream.foreachBatch(write), checkpoint)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_unseen`` has written."""
    return spark.read.parquet(f"{path}/rows").drop("run", "batch")


def folder_exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)


def split_rejects(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accepted records flattened to ``{path}/kept`` and rejected ones to ``{path}/rejected``, in one pass of the stream.

    Each micro-batch writes a folder of its own, which a retry overwrites.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        # Compressed, and deleted with the batch: checkpoints are neither.
        with held_table(records.parse_records(batch)) as parsed:
            for name, rows in (("kept", records.flatten(parsed)), ("rejected", records.rejected(parsed))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/run={run}/batch={number}")

    return start(documents.writeStream.foreachBatch(write), checkpoint)


def append_buckets(stream: DataFrame, path: str, checkpoint: str, bucket: str = "bucket") -> StreamingQuery:
    """File sink, one folder per bucket."""
    writer = stream.writeStream.format("parquet").partitionBy(bucket).option("path", path)
    # A stream keeps the settings it was started with.
    with unsorted_writes(stream.sparkSession):
        return start(writer.outputMode("append"), checkpoint)


def weekly_counts(stream: DataFrame, time: str, group: str, delay: str = "7 days") -> DataFrame:
    """Rows per Monday-based week and group.

    In append mode a week is given out once, when the watermark has passed its end; later rows
    of it are dropped and its state is freed. In complete mode all weeks stay and none is dropped.
    Windows count from a Thursday, so a start four days later falls on Mondays.
    """
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    week = F.window(time, "7 days", startTime="4 days")
    counted = marked.groupBy(week.alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("week"), group, "n")


def enrich(stream: DataFrame, code: str, taxonomy: DataFrame) -> DataFrame:
    """Add titles from a static taxonomy table."""
    return with_titles(stream, [code], taxonomy)


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Score a stream with a fitted or saved model."""
    return model.transform(stream)


def complete_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a small aggregate's whole current result as a parquet table."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return start(stream.writeStream.outputMode("complete").foreachBatch(write), checkpoint)


def append_final(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """File sink of rows that are given out once and never change."""
    return start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_all(make: Callable[[], StreamingQuery]) -> None:
    """Start a query, wait for its end, and raise what it raised."""
    query = make()
    query.awaitTermination()
