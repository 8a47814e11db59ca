"""Streams over given tables, as one file and as a folder of files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from occupipe import session
from occupipe.plans import streams
from occupipe.plans.registry import Tables
from occupipe.plans.streams import stream_scoring, stream_weekly_counts


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_of_any_number_of_files_is_streamed_whole(spark, tmp_path, files):
    rows = [(i, i % 2, [float(i % 2), float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    # Another table beside it is not read.
    df.write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    assert sorted(r["vec_id"] for r in stream_scoring(t).collect()) == list(range(60))


def test_a_table_that_is_one_file_is_streamed(spark, tmp_path):
    df = spark.range(20).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit("a").alias("event_type"))
    df.coalesce(1).write.parquet(f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.parquet")
    (tmp_path / "events.parquet").write_bytes(part.read_bytes())
    assert stream_weekly_counts(Tables(spark, str(tmp_path))).agg(F.sum("n")).first()[0] == 20


def test_a_record_stream_keeps_its_files_compressed_and_no_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "TEXT_ROWS", 20, raising=False)
    orders = spark.range(300).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "1.5d as o_totalprice", "date'2024-01-01' as o_orderdate", "'1-HIGH' as o_orderpriority"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    session.shared_dir(spark)
    top = Path(session._scratch(spark).removeprefix("file:"))
    before = set(top.glob("*")) | set(top.glob("*/rdd-*"))
    found = streams.stream_rejected_records(Tables(spark, str(tmp_path)))
    assert sorted(r["ad_id"] for r in found.collect()) == sorted(f"AD-{i}" for i in range(300) if i % 11 == 0 or i % 13 == 0)
    made = (set(top.glob("*")) | set(top.glob("*/rdd-*"))) - before
    # The files that arrive, the sink and the stream's own checkpoint.
    assert len(made) == 3 and not [p for p in made if p.name.startswith("rdd-")]
    texts = [p for folder in made for p in folder.glob("in-*/part-*")]
    assert len(texts) > 5 and all(p.name.endswith(".gz") for p in texts)
