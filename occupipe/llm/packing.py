"""Mixture-controlled packing by deficit round-robin over source queues (operator 2).

Each source is a queue of packets: its documents in table order, cut into packets of at most
one sequence. In every round, which fills one window of ``window`` sequences, a source earns
its quantum, its target share of the window's tokens, and sends the packets that its credit
covers. What is left, the deficit, is carried to the next round. A packet that ends at token e
of its queue is therefore sent in round ``(e - 1) // quantum``, whichever task holds it: credit
carries across windows and partitions without any task waiting for another. The stream of
packets, ordered by round, source and queue, is cut into full sequences, so only the last one
can be short. A source that runs dry leaves its part of the later windows to the others.

Target shares are weights by source. Without them they are the corpus's own token shares, so
that every window looks like the whole.

Defined results: a null text is empty, and an empty document still has its end token; a null
source is a queue of its own, like any other; repeated rows are packed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, ddl
from occupipe.llm.word_ids import WordIds, slices
from occupipe.operators.groups import lookup
from occupipe.session import through_table

SEQUENCE = 2048
WINDOW = 64
BLOCK_ROUNDS = 1024


def packets(docs: DataFrame, tokenizer: str, end: int, longest: int) -> DataFrame:
    """Packets with their ids and places: ``part`` is the task, ``upto`` the queue's tokens in it so far."""
    schema = f"{ddl(docs, 'doc_id', 'source')}, part int, upto bigint, start bigint, length int, doc_tokens bigint, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        wide = words.tokenizer.get_vocab_size() > 1 << 16
        part, queued = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, ends = words.encode(batch.column("text"))
                ids = ids.astype("<u4" if wide else "<u2")
                last = np.array([end], ids.dtype)
                row, upto, starts, sizes, totals, held = [], [], [], [], [], []
                begun = 0
                for i, (stop, source) in enumerate(zip(ends.tolist(), batch.column("source").to_pylist())):
                    own = np.concatenate([ids[begun:stop], last])
                    begun = stop
                    for at in range(0, len(own), longest):
                        piece = own[at : at + longest]
                        queued[source] += len(piece)
                        row.append(i)
                        upto.append(queued[source])
                        starts.append(at)
                        sizes.append(len(piece))
                        totals.append(len(own))
                        held.append(piece.tobytes())
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("source").take(row), pa.array([part] * len(row), pa.int32()),
                     pa.array(upto, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()),
                     pa.array(totals, pa.int64()), pa.array(held, pa.binary())],
                    names=["doc_id", "source", "part", "upto", "start", "length", "doc_tokens", "ids"],
                )

    return arrow(docs, cut, schema)


def queues(sizes: DataFrame, window_tokens: int, weights: dict[str, float] | None) -> DataFrame:
    """For each source and task: the tokens queued ``ahead``, the source's ``quantum`` and ``place``."""
    parts = sizes.groupBy("source", "part").agg(F.sum("length").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("source").agg(F.sum("n").alias("total"))
    if weights is None:
        totals = totals.withColumn("weight", F.col("total").cast("double"))
    else:
        given = F.lit(0.0)
        for name, weight in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(given)
        totals = totals.withColumn("weight", given)
    # One row per source: a short list of categories, not of documents.
    everyone = Window.partitionBy(F.lit(1))
    quantum = F.greatest(F.lit(1), F.round(F.col("weight") / F.sum("weight").over(everyone) * window_tokens)).cast("long")
    totals = totals.withColumn("quantum", quantum).withColumn("place", F.row_number().over(Window.orderBy("source")))
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = ahead.join(totals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "ahead", "quantum", "place")


def pack(
    docs: DataFrame, tokenizer: str, end: int = 1, sequence: int = SEQUENCE, window: int = WINDOW,
    weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The pieces of all sequences: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``window_id`` and ``source``.

    ``doc_id`` and ``start`` say which ids of which document lie at ``offset`` of the sequence.
    """
    own = docs.select(
        col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"), col(source).cast("string").alias("source")
    )
    held = through_table(packets(own, tokenizer, end, sequence))
    ahead = lookup(through_table(queues(held.select("source", "part", "length"), window * sequence, weights)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    queued = held.join(ahead, same).withColumn("_end", F.col("ahead") + F.col("upto"))
    queued = queued.withColumn("_round", F.expr("(_end - 1) div quantum")).withColumn("_begin", F.col("_end") - F.col("length"))
    turns = queued.groupBy("_round", "place").agg(F.sum("length").alias("n"), F.min("_begin").alias("first"))
    turns = through_table(turns.withColumn("block", F.expr(f"_round div {BLOCK_ROUNDS}")))
    # Running totals in two steps: over blocks of rounds, of which there are few, and within each.
    blocks = turns.groupBy("block").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("block").alias("_block"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("_round", "place").rowsBetween(Window.unboundedPreceding, -1)
    sent = turns.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, F.col("block") == F.col("_block"))
    shift = (F.col("base") + F.col("within") - F.col("first")).alias("shift")
    sent = sent.select(F.col("_round").alias("_r"), F.col("place").alias("_p"), shift).hint("shuffle_hash")
    placed = queued.join(sent, (F.col("_round") == F.col("_r")) & (F.col("place") == F.col("_p")))
    placed = placed.select(
        "doc_id", "source", "start", "length", "doc_tokens", "ids", F.col("_round").alias("window_id"),
        (F.col("_begin") + F.col("shift")).alias("at"),
    )
    schema = f"{ddl(placed, 'doc_id', 'source')}, window_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, sizes, sums, at = [], [], [], [], []
            names = ("start", "length", "at", "ids")
            for i, (start, length, begin, raw) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                ids = np.frombuffer(raw, f"<u{len(raw) // length}").astype("<u4")
                cut = min(length, -begin % sequence or sequence)
                for a, b in ((0, cut), (cut, length)):
                    if a < b:
                        row.append(i)
                        starts.append(start + a)
                        sizes.append(b - a)
                        sums.append(zlib.crc32(ids[a:b]))
                        at.append(begin + a)
            row, at = pa.array(row, pa.int64()), np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("source").take(row), batch.column("window_id").take(row),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 batch.column("doc_tokens").take(row), pa.array(at // sequence), pa.array(at % sequence)],
                names=["doc_id", "source", "window_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return arrow(placed, split, schema)
