"""Cross-entropy difference of matched n-gram models (operator 4).

A target and a background bigram model share one vocabulary: every word that both corpora
together hold ``min_seen`` times or more, and one unknown sign for the rest. The background's
counts are scaled to the target's mass, so that smoothing weighs alike in both models. A word's
probability backs off from the bigram to the unigram to a flat one. A document is scored by a
background that has not seen it: its own counts are taken out, so a text is not told to be like
the background because it is part of it, while a text that occurs again elsewhere is. Its score is its
loss per token under the target model less that under the background model: the lower, the
more it reads like the target.

Counts cover all texts, words and bigrams of both corpora and grow with them. Texts are coded in
blocks of about ``BLOCK_BYTES``. A block sends each of its distinct words, later each of its
distinct bigrams, once with its counts, as packed runs of sorted 64-bit hashes to the part that
holds this range of hashes; the part adds up and answers each block with the totals of its keys.
So a hot word or bigram reaches its part once a block, parts grow in number and not in size, and
the driver sees a few sums only. Each round's totals are written and its shuffles then deleted, so
disk holds one round at a time. Two of n bigrams share a hash with a chance of about n^2 / 2^65.

Defined results: null and empty texts have no tokens and score 0; an empty target or background
has a flat model; repeated rows count each time, and one of them is in the background of the other; null ids are scored; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, ddl
from occupipe.llm.word_ids import slices
from occupipe.session import freed_shuffles, through_table

MIN_SEEN = 2
BACKOFF = 20.0
BLOCK_BYTES = 8 << 20
PARTS = 256
PART_KEYS = 4_000_000
HASH_SEED = 42
UNKNOWN, START = 0, 1  # hashes of the unknown sign and of the sign for the start of a text


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-case words as a dictionary array, and where each text's words begin and end."""
    parts = pc.ascii_split_whitespace(pc.utf8_trim(pc.utf8_lower(pc.fill_null(texts, "")), characters=" \t\n\r\x0b\x0c"))
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return parts.flatten().dictionary_encode(), offsets - offsets[0]


def _both(docs: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str) -> DataFrame:
    one = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), F.lit(False).alias("wanted"))
    none = F.lit(None).cast(one.schema["doc_id"].dataType).alias("doc_id")
    return one.union(target.select(none, col(target_text).alias("text"), F.lit(True).alias("wanted")))


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte in planes, so that the many zero bytes take little."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed).view(np.uint64), dtype=np.uint64)


def _coded(both: DataFrame) -> DataFrame:
    """One row for a block of texts: ids, sides, tokens of each text, word hashes and the words' codes."""

    def hashed(word: str) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), HASH_SEED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                found, offsets = tokens(batch.column("text"))
                code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                names = found.dictionary.to_pylist()
                # A blank text splits into one empty word; it has no tokens.
                real = np.array([w != "" for w in names], bool)[code] if len(names) else np.zeros(0, bool)
                text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[real]
                hashes, own = np.unique(np.array([hashed(w) for w in names], np.uint64), return_inverse=True)
                code = own[code[real]]
                # Frequent words have small codes, which pack well.
                order = np.argsort(-np.bincount(code, minlength=len(hashes)), kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                sizes = np.bincount(text, minlength=batch.num_rows)
                cells = [pa.array([_pack(x)]) for x in (batch.column("wanted").to_numpy(zero_copy_only=False), sizes, hashes[order].view(np.int64), place[code])]
                ids = batch.column("doc_id")
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), held, pa.array([len(code)], pa.int64()), *cells], names=["block", "ids", "n", "wanted", "sizes", "words", "codes"]
                )

    id_type = dict(both.dtypes)["doc_id"]
    return arrow(both, each, f"block string, ids array<{id_type}>, n bigint, wanted binary, sizes binary, words binary, codes binary")


def _block(row: dict) -> tuple[np.ndarray, ...]:
    """A block's word hashes, and of each token its side, its text, its code and the code before it, -1 at the start."""
    wanted, sizes, words, code = (_unpack(row[c]) for c in ("wanted", "sizes", "words", "codes"))
    text = np.repeat(np.arange(len(sizes)), sizes)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
    return words.view(np.uint64), wanted[text], text, code, before


def _runs(block: str, keys: np.ndarray, counts: list[np.ndarray], parts: int) -> pa.Table:
    """Sorted keys and their counts, cut where a part ends."""
    part = (keys >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else []
    spans = list(zip(edges, edges[1:]))
    return pa.table({
        "part": pa.array([int(part[a]) for a, _ in spans], pa.int64()),
        "block": pa.array([block] * len(spans), pa.string()),
        "keys": pa.array([_pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
        "counts": pa.array([_pack(np.concatenate([c[a:b] for c in counts])) for a, b in spans], pa.binary()),
    })


RUNS = "part bigint, block string, keys binary, counts binary"


def _totals(runs: DataFrame, kinds: int, min_seen: int) -> DataFrame:
    """Each run's totals over all blocks; a part's row without a block has the number of its
    keys seen often enough, the sums over all its keys, and those over its rare keys."""

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        parted = [_unpack(c).reshape(kinds, -1) for c in table.column("counts").to_pylist()]
        sums = [np.bincount(at, weights=np.concatenate([c[k] for c in parted]), minlength=len(known)).astype(np.int64) for k in range(kinds)]
        often = sums[0] + sums[1] >= min_seen
        told = [_pack(np.concatenate([x[at[a:b]] for x in sums])) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        whole = _pack(np.array([often.sum(), *[x.sum() for x in sums], *[x[~often].sum() for x in sums]]))
        blocks = [*table.column("block").to_pylist(), None]
        return pa.table({"part": pa.array([part] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.string()), "totals": pa.array([*told, whole], pa.binary())})

    with freed_shuffles(runs.sparkSession):
        return through_table(runs.groupBy("part").applyInArrow(add, "part bigint, block string, totals binary"))


def _joined(coded: DataFrame, *answers: DataFrame) -> GroupedData:
    """Each block's row, and the rows that answer it."""
    rows = coded.withColumn("round", F.lit(0))
    for at, answer in enumerate(answers, 1):
        rows = rows.unionByName(answer.filter("block is not null").withColumn("round", F.lit(at)), allowMissingColumns=True)
    return rows.groupBy("block")


def _answer(rows: list[dict], at: int, kinds: int) -> np.ndarray:
    """The totals of a block's sorted keys."""
    found = sorted((r for r in rows if r["round"] == at), key=lambda r: r["part"])
    return np.concatenate([np.zeros((kinds, 0), np.int64), *[_unpack(r["totals"]).reshape(kinds, -1) for r in found]], axis=1)


def _pairs(words: np.ndarray, code: np.ndarray, before: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted bigram hashes, where each first stands, and which one each token is."""
    own = np.where(rare, np.uint64(UNKNOWN), words)
    first = np.append(own, np.uint64(START))[before]
    z = (first ^ (first >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + own[code]
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(z ^ (z >> np.uint64(32)), return_index=True, return_inverse=True)


def _within(text: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """How often each token's sign stands in the token's own text."""
    low = sign - sign.min(initial=0)
    _, at, n = np.unique(text * (low.max(initial=0) + 1) + low, return_inverse=True, return_counts=True)
    return n[at]


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    min_seen: int = MIN_SEEN, backoff: float = BACKOFF,
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` of every document.

    The background model of a document is that of all other rows of ``docs``. Losses are bits per
    token. ``backoff`` is the weight of the unigram in a bigram's probability, in tokens.
    """
    both = _both(docs, target, doc_id, text, target_text)
    coded = through_table(_coded(both))
    parts = PARTS
    while parts * PART_KEYS < (coded.agg(F.sum("n")).first()[0] or 0):
        parts *= 2

    def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, wanted, _, code, before = _block(row)
                order = np.argsort(hashes)
                counts = [np.bincount(code[wanted == side], minlength=len(hashes))[order] for side in (1, 0)]
                # How often a word stands before another.
                counts += [np.bincount(before[(wanted == side) & (before >= 0)], minlength=len(hashes))[order] for side in (1, 0)]
                yield from _runs(row["block"], hashes[order], counts, parts).to_batches()

    by_word = _totals(arrow(coded, word_runs, RUNS), 4, min_seen)
    whole = sum((_unpack(r["totals"]) for r in by_word.filter("block is null").select("totals").collect()), np.zeros(9, np.int64))
    kinds = int(whole[0]) + 1
    mass = whole[1:3].astype(float)
    # Texts that begin are the tokens that no word stands before.
    starts = whole[1:3] - whole[3:5]
    unknown = whole[5:9]
    scale = np.array([1.0, mass[0] / mass[1] if mass.all() else 1.0])

    def known(row: dict, rows: list[dict]) -> tuple[np.ndarray, ...]:
        """The block, which of its words are rare, and the words' totals with those of the start sign last."""
        hashes, wanted, text, code, before = _block(row)
        totals = np.empty((4, len(hashes)), np.int64)
        totals[:, np.argsort(hashes)] = _answer(rows, 1, 4)
        rare = totals[0] + totals[1] < min_seen
        totals[:, rare] = unknown[:, None]
        return hashes, wanted, text, code, before, rare, np.concatenate([totals, [[0], [0], [starts[0]], [starts[1]]]], axis=1)

    def bigram_runs(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["round"] == 0)
        hashes, wanted, _, code, before, rare, _ = known(row, rows)
        keys, _, at = _pairs(hashes, code, before, rare)
        return _runs(row["block"], keys, [np.bincount(at[wanted == side], minlength=len(keys)) for side in (1, 0)], parts)

    by_bigram = _totals(_joined(coded, by_word).applyInArrow(bigram_runs, RUNS), 2, 1)

    def score(table: pa.Table) -> pa.Table:
        at_row = pc.index(table.column("round"), 0).as_py()
        rows = table.drop_columns("ids").to_pylist()
        row = rows[at_row]
        hashes, _, text, code, before, rare, totals = known(row, rows)
        keys, _, at = _pairs(hashes, code, before, rare)
        # All rare words are one sign; the sign for the start stands last.
        before_sign = np.append(np.where(rare, -1, np.arange(len(rare))), len(rare))[before]
        pairs = _answer(rows, 2, 2)
        side, sizes = _unpack(row["wanted"]), _unpack(row["sizes"])
        per = np.maximum(sizes, 1)
        # What the document itself adds to the background's counts, of each token's pair, word and word before.
        own_pairs, own_words, own_before = (_within(text, x) for x in (at, np.where(rare, -1, np.arange(len(rare)))[code], before_sign))
        sums = []
        for k in (0, 1):
            gone = (own_pairs, own_words, own_before, sizes[text]) if k else (0, 0, 0, 0)
            flat = ((totals[k][code] - gone[1]) * scale[k] + 1) / ((mass[k] - gone[3]) * scale[k] + kinds)
            pair, first = (pairs[k][at] - gone[0]) * scale[k], (totals[2 + k][before] - gone[2]) * scale[k]
            loss = -np.log2((pair + backoff * flat) / (first + backoff))
            sums.append(np.bincount(text, weights=loss, minlength=len(sizes)) / per)
        ids = pa.concat_arrays([c for c in table.column("ids").slice(at_row, 1).chunks if len(c)]).flatten()
        columns = [ids, pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[0] - sums[1])]
        made = pa.table(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        return made.filter(pa.array(side == 0))

    schema = f"{ddl(both, 'doc_id')}, n_tokens bigint, target_loss double, background_loss double, score double"
    return _joined(coded, by_word, by_bigram).applyInArrow(score, schema)
