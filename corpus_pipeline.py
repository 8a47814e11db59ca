"""The corpus pipeline: documents in, packed training sequences out, one table per stage.

Every stage takes all rows its predecessor kept. All but the last return the columns they were
given; each call of a stage gives the same rows wherever its input's rows lie, up to ties that
a stage's operator documents.

Defined results: documents with null or empty texts pass the filters, and the near-duplicate
stage keeps one of them. Rows with a null id pass every stage but that one, where such a row
still counts as a copy; rows that repeat an id and a text pass or go together. Empty ``documents``
give no rows; without labels the toxicity stage rejects nothing, and without benchmark items the
decontamination stage does not. Whole texts are read, however long. Further columns, whatever
their names, are carried through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from occupipe.llm import counterfactual, decontaminate, packing, simhash, templates
from occupipe.session import through_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Learned from the labels, less the held-out part of operator 9."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = counterfactual.learn(documents, labels, parts=5, held=0)
    return counterfactual.without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Records of recurring templates stay in the first document that has them and go from the others."""
    return templates.without_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints of four-word shingles that differ in 4 bits or fewer, the first stays."""
    return simhash.first_of_each(docs, words=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage within its edit budget go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens in the corpus's own mixture of sources."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: No SQL: three stages are learned, hashed or aligned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = through_table(docs)
    return docs
