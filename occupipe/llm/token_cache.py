"""Token counts through a digest cache (operator 6).

Texts are keyed by the SHA-256 of their normalised content and tokenizers by that of their
file. Counts already stored under both are joined; each distinct text without one is encoded
once, whatever its number of copies, and appended to the stored table. The table is kept between
runs: a run over texts that were counted before encodes only the new ones. Runs that meet may
store a digest twice; readers take one.

Defined results: a null text counts as empty; equal texts share a count; an empty table gives
no rows; repeated rows stay repeated; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col
from occupipe.llm.word_ids import slices
from occupipe.session import through_table

CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file: a changed file never meets old counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counter(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            sizes = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            sizes = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = sizes(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest"), pa.array([version] * len(found)), pa.array(found, pa.int64())],
                    names=["digest", "tokenizer", "n_tokens"],
                )

    return count


def stored_counts(spark, cache: str, version: str) -> DataFrame:
    """One count per digest; writers that met may have stored a digest twice."""
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text", normalise=lambda c: c
) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every whole text.

    ``cache`` is the folder of the stored table, made if missing. ``normalise`` maps the text
    column to content with the same token count; by default the text itself, since no
    normalisation is neutral for every tokenizer.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache)
    whole: Column = F.coalesce(col(text), F.lit(""))
    content = normalise(whole)
    digest = F.unhex(F.sha2(content, 256))
    keyed = docs.select(col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias("digest"))
    # Copies meet in the map tasks first, so a text with many copies is not gathered.
    distinct = docs.select(digest.alias("digest"), content.alias("text")).groupBy("digest").agg(F.any_value("text").alias("text"))
    missing = distinct.join(stored_counts(spark, cache, version).select("digest"), "digest", "left_anti")
    arrow(missing, _counter(path, version), CACHE).write.mode("append").parquet(cache)
    # Only what these documents ask for, not the whole cache. Written first, so that the join has a
    # shuffle of its own and a text with many copies can be split.
    counts = through_table(stored_counts(spark, cache, version).join(keyed.select("digest").distinct(), "digest", "left_semi"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
