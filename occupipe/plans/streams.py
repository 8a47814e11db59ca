"""Queries that run a stream to its end and read its sink."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from occupipe.operators import cascade as M
from occupipe.plans.ingest import FLAT_SQL, flat_result, order_documents
from occupipe.plans.registry import CODE_SQL, TAXONOMY_SQL, code_of, query
from occupipe.session import freed_shuffles, held_table, shared_dir
from occupipe.streaming import stream as ST


@query(
    "stream_weekly_counts",
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_weekly_counts(t):
    path = shared_dir(t.spark)
    counted = ST.weekly_counts(t.stream("events"), "ts", "event_type")
    ST.run_all(lambda: ST.complete_to_table(counted, path, shared_dir(t.spark)))
    back = t.spark.read.parquet(path)
    return back.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n")


@query(
    "stream_enrichment",
    f"WITH {TAXONOMY_SQL} SELECT event_id, {CODE_SQL.format('user_id')} AS code, title AS code_title FROM events LEFT JOIN taxonomy ON {CODE_SQL.format('user_id')} = code",
)
def stream_enrichment(t):
    path = shared_dir(t.spark)
    coded = t.stream("events").select("event_id", code_of(F.col("user_id")).alias("code"), F.col("event_type").alias("bucket"))
    ST.run_all(lambda: ST.append_buckets(ST.enrich(coded, "code", t.taxonomy()), path, shared_dir(t.spark)))
    return t.spark.read.parquet(path).select("event_id", "code", "code_title")


#: Rows of a file that arrives.
FILE_ROWS = 500_000
#: The same of compressed text, which one task reads whole.
TEXT_ROWS = 100_000


def arrivals(t, df, part, n: int, write="parquet") -> tuple[str, int]:
    """A folder of ``n`` lots of files that arrived one after the other, and how many files each lot has.

    Lot k holds the rows whose ``part`` is k, in as many files as the largest lot needs; a lot
    of too few rows has empty files among them. So a micro-batch of that many files is one lot.
    """
    folder, context = shared_dir(t.spark), t.spark.sparkContext
    # Text is several times as large as what it was made of; parquet is compressed by itself.
    packed, most = ({"compression": "gzip"}, min(TEXT_ROWS, FILE_ROWS)) if write == "text" else ({}, FILE_ROWS)
    with held_table(df.withColumn("_part", part)) as rows, freed_shuffles(t.spark):
        sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # at most ``n`` numbers
        files = max(1, -(-max(sizes.values(), default=0) // most))
        for k in range(n):
            lot = rows.filter(F.col("_part") == k).drop("_part")
            save = lambda frame: frame.write.mode("append").options(**packed).format(write).save(f"{folder}/in-{k}")
            save(lot.coalesce(1) if files == 1 else lot.repartition(files))
            path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/in-{k}")
            fs = path.getFileSystem(context._jsc.hadoopConfiguration())
            listed = lambda: [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
            for _ in range(files - len(listed())):
                save(lot.limit(0))
            for file in listed():
                # A stream takes files in the order of their times.
                fs.setTimes(file, 1_700_000_000_000 + 60_000 * k, -1)
    return folder, files


# Files of a sixth of the events each; one event in seventeen arrives three files late.
PARTS = 6
PART_SQL = f"CAST(least({PARTS - 1}, event_id * {PARTS} // n + CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END) AS INT)"


def in_parts(t, *columns: str):
    events = t.events.select(*columns)
    late = F.when(F.col("event_id") % 17 == 0, 3).otherwise(0)
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("event_id") * PARTS / F.col("_n")) + late).cast("int")
    return events.withColumn("_n", F.lit(t.events.count())), part


def part_stream(t, lots: tuple[str, int], schema, parts: str = "*"):
    """One lot a micro-batch."""
    folder, files = lots
    reader = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/in-{parts}")


@query(
    "stream_unseen_ids",
    f"""
    WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT user_id, event_id, {PART_SQL} AS part FROM events, n)
    SELECT user_id, event_id, part FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1
    """,
)
def stream_unseen_ids(t):
    """The first event of each user over six micro-batches, a restart after three of them and a second stream over all."""
    events, part = in_parts(t, "event_id", "user_id")
    events = events.withColumn("part", part).withColumn("bucket", F.col("user_id") % 4)
    lots = arrivals(t, events.drop("_n"), F.col("part"), PARTS)
    path, checkpoint, kind = shared_dir(t.spark), shared_dir(t.spark), events.drop("_n").schema
    append = lambda source, check: ST.run_all(lambda: ST.append_unseen(source, "user_id", path, check, order=["event_id"], slots=16))
    append(part_stream(t, lots, kind, "[012]"), checkpoint)
    append(part_stream(t, lots, kind), checkpoint)
    append(part_stream(t, lots, kind), shared_dir(t.spark))
    return ST.appended(t.spark, path).select("user_id", "event_id", "part")


@query(
    "stream_final_weeks",
    f"""
    WITH n AS (SELECT count(*) AS n FROM events),
    e AS (SELECT ts, event_type, {PART_SQL} AS part, date_trunc('week', ts) AS week FROM events, n),
    p AS (SELECT part, max(ts) AS latest FROM e GROUP BY 1),
    w AS (SELECT a.part, max(b.latest) - INTERVAL 1 DAY AS mark FROM p a LEFT JOIN p b ON b.part <= a.part - 2 GROUP BY 1),
    kept AS (SELECT e.* FROM e JOIN w USING (part) WHERE mark IS NULL OR week + INTERVAL 7 DAY > mark)
    SELECT strftime(week, '%Y-%m-%d') AS week, event_type, count(*) AS n FROM kept
    WHERE week + INTERVAL 7 DAY <= (SELECT max(latest) - INTERVAL 1 DAY FROM p) GROUP BY 1, 2
    """,
)
def stream_final_weeks(t):
    """Weeks given out once the watermark has passed them, over six ordered files.

    A row is late if its week had ended by the watermark of the batch before its own; the last weeks stay open.
    """
    events, part = in_parts(t, "event_id", "ts", "event_type")
    lots = arrivals(t, events, part, PARTS)
    kind = events.schema
    path = shared_dir(t.spark)
    counted = ST.weekly_counts(part_stream(t, lots, kind), "ts", "event_type", "1 day")
    ST.run_all(lambda: ST.append_final(counted, path, shared_dir(t.spark)))
    back = t.spark.read.schema(counted.schema).parquet(path)
    return back.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n")


@query(
    "stream_repeats_within_delay",
    f"""
    WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT user_id % 5 AS key, ts, CAST(event_id * {PARTS} // n AS INT) AS part FROM events, n),
    f AS (SELECT DISTINCT key, part FROM e) SELECT key, part FROM f WHERE part % 2 = 0
    """,
)
def stream_repeats_within_delay(t):
    """The first row of an id, and again once its state is gone.

    The watermark of a file passes the delay of the rows before it only when that file has been read, so an id
    is still held back there and is given out again in the file after.
    """
    events = t.events.select("event_id", "ts", "user_id").withColumn("_n", F.lit(t.events.count()))
    part = (F.col("event_id") * PARTS / F.col("_n")).cast("int")
    events = events.select((F.col("user_id") % 5).alias("key"), "ts", part.alias("part"))
    lots = arrivals(t, events, F.col("part"), PARTS)
    once = ST.skip_repeats(part_stream(t, lots, events.schema), "key", "ts", "1 minute")
    path = shared_dir(t.spark)
    ST.run_all(lambda: ST.append_final(once, path, shared_dir(t.spark)))
    return t.spark.read.schema(once.schema).parquet(path).select("key", "part")


def record_stream(t, files: int = 5):
    """The order records as JSON lines in files that arrive one after the other."""
    docs = order_documents(t).select(F.to_json(F.struct("ad_id", "doc")).alias("value"))
    return arrivals(t, docs, F.pmod(F.xxhash64("value"), F.lit(files)).cast("int"), files, "text")


@query("stream_flattened_records", FLAT_SQL)
def stream_flattened_records(t):
    """Records over several micro-batches and a restart with new files; rejects go to a sink of their own."""
    return flat_result(t.spark.read.parquet(f"{_split_stream(t)}/kept"))


@query(
    "stream_rejected_records",
    """
    SELECT 'AD-' || o_orderkey AS ad_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not found' ELSE 'missing required key' END AS reject_reason
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
    """,
)
def stream_rejected_records(t):
    return t.spark.read.parquet(f"{_split_stream(t)}/rejected").select("ad_id", "reject_reason")


def _split_stream(t) -> str:
    (folder, size), path, checkpoint = record_stream(t), shared_dir(t.spark), shared_dir(t.spark)
    for files in ("[01]", "*"):
        lines = t.spark.readStream.schema("value string").option("maxFilesPerTrigger", 2 * size).format("text").load(f"{folder}/in-{files}")
        documents = lines.select(F.from_json("value", "ad_id string, doc string").alias("r")).select("r.*")
        ST.run_all(lambda: ST.split_rejects(documents, path, checkpoint))
    return path


@query("stream_scoring")
def stream_scoring(t):
    """Fit and save on the batch table, load, and score the same table as a stream."""
    vectors = lambda df: M.with_vector(df.select("vec_id", "label", "embedding"), "embedding", "features")
    fitted = M.fit_cascade(vectors(t.embeddings), "features", {1: "label"}, max_iter=10)
    saved, path = shared_dir(t.spark), shared_dir(t.spark)
    fitted.save(saved)
    model = PipelineModel.load(saved)
    scored = ST.score_stream(vectors(t.stream("embeddings")), model)
    kept = scored.select("vec_id", F.col("pred_1").cast("int").alias("predicted"), F.col("label").alias("bucket"))
    ST.run_all(lambda: ST.append_buckets(kept, path, shared_dir(t.spark)))
    return t.spark.read.parquet(path).select("vec_id", "predicted")
