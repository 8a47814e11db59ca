"""Token sequences for language modelling: encode, pad, pack and mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from occupipe.functions import fixed_values as fixed
from occupipe.operators.groups import lookup_each, md5_coin, md5_coins, with_row_index

MILLION = 1_000_000
VOCABULARY_LIMIT = 500_000


def nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).rlike(r"(?U)[^\s\x1c-\x1f]"))


def one_line(column: Column) -> Column:
    """Text on one line, for sinks that hold one document per line."""
    return F.regexp_replace(column, r"[\r\n]+", " ")


def word_tokens(column: Column) -> Column:
    """Lowercase words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"(?U)\w+|[^\w\s\x1c-\x1f]"), F.lit(0))


def vocabulary(df: DataFrame, column: str, first_id: int = 0) -> DataFrame:
    """Distinct tokens in order with dense ids: token, token_id."""
    tokens = df.select(F.explode(word_tokens(F.col(column))).alias("token")).distinct()
    numbered = with_row_index(tokens, [F.asc("token")], "token_id")
    return numbered.withColumn("token_id", (F.col("token_id") + first_id).cast("int"))


def encode_tokens(df: DataFrame, key: str, column: str, vocab: DataFrame, unknown: int) -> DataFrame:
    """Token ids and word numbers per nonblank document.

    A vocabulary counted to have at most ``VOCABULARY_LIMIT`` tokens goes to every task, and
    documents are encoded where they lie: a shuffle of tokens would move more than the text
    itself. A larger one is joined. Both give the same rows.
    """
    texts = nonblank(df, column).select(key, column)
    found = lookup_each(texts, word_tokens(F.col(column)), vocab, "token", "token_id", "_ids", VOCABULARY_LIMIT)
    ids = F.transform("_ids", lambda i: F.coalesce(i, F.lit(unknown)).cast("int"))
    encoded = found.select(key, ids.alias("input_ids"))
    return encoded.withColumn("word_ids", F.transform("input_ids", lambda _, i: i))


def fixed_length(ids: Column, n: int = fixed.SEQUENCE_LENGTH, pad: int = 0) -> Column:
    """Truncate or pad to ``n``; struct of input_ids and attention_mask."""
    kept = F.slice(ids, 1, n)
    missing = n - F.size(kept)
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(pad), missing)).alias("input_ids"),
        F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )


def pack_blocks(df: DataFrame, shard: str, order: str, tokens: str, size: int) -> DataFrame:
    """Concatenate a shard's sequences in order and cut them into blocks of ``size``.

    The last, shorter block of a shard is dropped. Start offsets come from a running sum
    of lengths; each sequence is then cut where the blocks end, and only these slices are
    regrouped, at most ``size`` tokens to a block. ``shard`` is a fixed number of rows.
    """
    before = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lengths = df.select(shard, order, tokens, F.size(tokens).cast("bigint").alias("_n"))
    placed = lengths.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = F.col("_from") + F.col("_n") - 1
    block = lambda at: F.floor(at / size)
    # An empty sequence has no block; a filter on its length would run the encoder twice.
    blocks = F.when(F.col("_n") > 0, F.sequence(block(F.col("_from")), block(last)))
    cut = placed.select(shard, tokens, "_from", F.explode(blocks).alias("block"))
    start = F.greatest(F.col("block") * size, F.col("_from"))
    end = F.least((F.col("block") + 1) * size, F.col("_from") + F.size(tokens))
    piece = F.slice(
        F.col(tokens), (start - F.col("_from") + 1).cast("int"), (end - start).cast("int")
    )
    pieces = cut.select(shard, "block", F.struct(start.alias("at"), piece.alias("piece")).alias("p"))
    grouped = pieces.groupBy(shard, "block").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    whole = grouped.select(shard, "block", F.flatten(F.transform("_p", lambda p: p["piece"])).alias("input_ids"))
    return whole.filter(F.size("input_ids") == size)


def _masked(ids: Column, hit: Column, mask_id: int) -> tuple[Column, Column]:
    inputs = F.zip_with(ids, hit, lambda t, h: F.when(h, F.lit(mask_id)).otherwise(t))
    labels = F.zip_with(ids, hit, lambda t, h: F.when(h, t).otherwise(F.lit(fixed.IGNORE_LABEL)))
    return inputs, labels


def mask_tokens(
    df: DataFrame,
    key: str,
    ids: str,
    mask_id: int,
    share: float = fixed.MASK_SHARE,
    seed: int = 1,
    keep: float = 0.1,
    replace: float = 0.1,
    vocab_size: int | None = None,
) -> DataFrame:
    """Choose each token with the given probability; label it, and mask it.

    Of the chosen tokens a share is kept as it is and a share becomes another token of
    the vocabulary. Without ``vocab_size`` none is replaced by another token.
    """
    # An md5 coin, so that SQL can draw the same tokens.
    draw = lambda i, salt: md5_coin(seed, F.col(key), i, F.lit(salt)) % MILLION
    replace = replace if vocab_size else 0.0

    def shown(token: Column, i: Column) -> Column:
        second = draw(i, 1)
        out = F.when(draw(i, 0) >= share * MILLION, token).when(second < keep * MILLION, token)
        if vocab_size:
            other = (md5_coin(seed, F.col(key), i, F.lit(2)) % vocab_size).cast("int")
            out = out.when(second < (keep + replace) * MILLION, other)
        return out.otherwise(F.lit(mask_id))

    labels = F.transform(
        ids, lambda t, i: F.when(draw(i, 0) < share * MILLION, t).otherwise(F.lit(fixed.IGNORE_LABEL))
    )
    return df.withColumn("labels", labels).withColumn(ids, F.transform(ids, shown))


def mask_whole_words(
    df: DataFrame, key: str, ids: str, word_ids: str, mask_id: int, share: float = 0.2, seed: int = 1
) -> DataFrame:
    """Mask all tokens of a chosen word. Tokens with a null word number are never chosen.

    Words are told apart by runs: a number that comes back later is another word. Rows
    are packed blocks, so the running number is over a few hundred tokens.
    """
    names, most = df.columns, share * MILLION

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words = lists.flatten()
            at = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
            row, word = np.repeat(np.arange(len(sizes)), sizes)[at], words.take(pa.array(at)).to_numpy(zero_copy_only=False)
            begins = np.ones(len(at), bool)
            begins[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            # Runs are numbered from 0 in each row, and one coin is drawn for a run.
            runs = np.bincount(row[begins], minlength=len(sizes))
            coins = [md5_coins(k, np.arange(n), seed) for k, n in zip(batch.column("_key").to_pylist(), runs.tolist())]
            drawn = np.concatenate([np.zeros(0, np.uint64), *coins]) % np.uint64(MILLION) < most
            hit = np.zeros(len(words), bool)
            hit[at] = drawn[np.cumsum(begins) - 1]
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            hits = pa.ListArray.from_arrays(ends, pa.array(hit), mask=pc.is_null(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], hits], names=[*names, "_hit"])

    kind = StructType([*df.schema.fields, StructField("_hit", ArrayType(BooleanType()))])
    shown = df.withColumns({"_key": F.col(key).cast("string"), "_words": F.col(word_ids).cast("array<int>")})
    staged = shown.mapInArrow(choose, kind)
    inputs, labels = _masked(F.col(ids), F.col("_hit"), mask_id)
    return staged.withColumn("labels", labels).withColumn(ids, inputs).drop("_hit")
