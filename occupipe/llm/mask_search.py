"""Ranked lexical search by presence masks (operator 12).

Every document is read once: its terms are counted, and the counts of those terms that some
item holds are written with the number of all its terms. Terms are maximal runs of ASCII
letters, digits and characters beyond ASCII, with only A-Z lower-cased. From the written rows come N (documents with at least
one term), L (terms of all documents) and each term's df.

The written documents are then searched in blocks within the tasks. A term's documents in a
block are a bitmap. For an item, the OR of the bitmaps of its essential terms (those without
which the rest cannot reach the item's 10th score so far) gives the documents that can still
enter. Stacked, the bitmaps of all its terms give each such document its mask of matched
terms, and documents of one mask form a group. A mask's maximum score is the sum of its terms'
largest contributions in the block. Masks are evaluated by descending maximum, and the search
of the block ends once the next maximum is below the k-th score found. The best k of an item
are carried from block to block of a task, and the tasks' are merged, so results are exact.

Items are taken in blocks of about ``PAIRS`` pairs of item and term; each block is a broadcast
of bounded size and a pass over the documents.

Defined results: null and empty texts have no terms; an item without terms that occur has no
rows; items that share an id are one item with the terms of all of them; null item ids give no
rows. Every row of the documents counts as a document, also one that repeats another's id; rows
with a null id count in N, L and df but are never ranked. Documents scored 0 are left out.
Other columns are ignored. All counts are 64-bit integers; ``div`` rounds down.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col
from occupipe.llm.word_ids import slices
from occupipe.operators.groups import top_k_per
from occupipe.session import through_table

PAIRS = 200_000
BLOCK = 8192
BLOCK_HITS = 1 << 20
COUNTED = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
RESULT = "item_id bigint, doc_id bigint, score bigint"
#: Each byte as it stands in a term; bytes between terms become spaces.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The text's terms as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id`` and ``term``, once for each distinct term of an item."""
    rows = items.select(col(item_id).cast("long").alias("item_id"), col(text).alias("text")).filter("item_id is not null and text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
                ids = np.repeat(batch.column("item_id").to_numpy(zero_copy_only=False), [len(t) for t in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    return arrow(rows, each, "item_id bigint, term binary").distinct()


def counted(docs: DataFrame, numbers: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Each document's number of terms, and the numbers and frequencies of those that items hold."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, terms, tfs = [], [], []
                for one in batch.column("text").to_pylist():
                    words = terms_of(one)
                    sizes.append(len(words))
                    found = {known[w]: n for w, n in Counter(words).items() if w in known}
                    terms.append(list(found))
                    tfs.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return arrow(rows, each, COUNTED)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of about ``BLOCK`` documents or ``BLOCK_HITS`` matched terms."""
    held, rows, hits = [], 0, 0
    for whole in batches:
        ends = np.append(0, np.cumsum([len(t) for t in whole.column("terms")]))
        at = 0
        while at < whole.num_rows:
            # A document with more terms than a block's share is a block's last.
            room = int(np.searchsorted(ends, ends[at] + max(1, BLOCK_HITS - hits)))
            stop = min(whole.num_rows, at + BLOCK - rows, max(at + 1, room))
            held.append(whole.slice(at, stop - at))
            rows, hits = rows + stop - at, hits + int(ends[stop] - ends[at])
            at = stop
            if rows >= BLOCK or hits >= BLOCK_HITS:
                yield pa.Table.from_batches(held)
                held, rows, hits = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """The postings of a block: per term its documents and their contributions to a score."""

    def __init__(self, table: pa.Table, weights: np.ndarray, documents: int, total: int) -> None:
        self.ids = table.column("doc_id").to_numpy()
        n = table.column("n").to_numpy().astype(np.int64)
        m = 10 + (90 * n * documents) // max(1, total)
        lists = table.column("terms").combine_chunks()
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        tfs = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        worth = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
        order = np.argsort(terms, kind="stable")
        self.owner, self.worth = owner[order], worth[order]
        self.terms, begun = np.unique(terms[order], return_index=True)
        self.ends = np.append(begun, len(order))
        self.most = np.maximum.reduceat(self.worth, begun) if len(begun) else np.zeros(0, np.int64)

    def best(self, terms: np.ndarray, k: int, held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The best ``k`` of ``held`` and the block, as pairs of negated score and id, for an item's terms."""
        places = np.searchsorted(self.terms, terms)
        places = places[(places < len(self.terms)) & (self.terms[np.minimum(places, len(self.terms) - 1)] == terms)] if len(self.terms) else places[:0]
        places = places[self.most[places] > 0]
        if not len(places):
            return held
        places = places[np.argsort(self.most[places], kind="stable")]
        most = self.most[places]
        floor = -held[-1][0] if len(held) == k else 1
        essential = int(np.searchsorted(np.cumsum(most), floor))
        if essential == len(places):
            return held
        spans = [slice(self.ends[p], self.ends[p + 1]) for p in places]
        able = np.zeros(len(self.ids), bool)
        for s in spans[essential:]:
            able[self.owner[s]] = True
        docs = np.flatnonzero(able)
        row_of = np.full(len(self.ids), -1)
        row_of[docs] = np.arange(len(docs))
        present = np.zeros((len(places), len(docs)), bool)
        worth = np.zeros((len(places), len(docs)), np.int64)
        for i, s in enumerate(spans):
            at = row_of[self.owner[s]]
            kept = at >= 0
            present[i, at[kept]] = True
            worth[i, at[kept]] = self.worth[s][kept]
        # Groups of documents by mask, in order of the masks' greatest possible scores.
        packed = np.ascontiguousarray(np.packbits(present, axis=0).T)
        masks, first, group = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        reach = most @ present[:, first]
        order = np.argsort(-reach, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(group, minlength=len(masks))))
        at, take = 0, 1
        while at < len(order) and reach[order[at]] >= floor:
            now = order[at : at + take]
            now = now[reach[now] >= floor]
            own = np.concatenate([members[ends[g] : ends[g + 1]] for g in now])
            scores = worth[:, own].sum(0)
            own, scores = own[scores >= floor], scores[scores >= floor]
            ids = self.ids[docs[own]]
            first_k = np.lexsort((ids, -scores))[:k]
            held = sorted([*held, *zip((-scores[first_k]).tolist(), ids[first_k].tolist())])[:k]
            floor = -held[-1][0] if len(held) == k else 1
            at, take = at + take, take * 2
        return held


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents above 0."""
    spark = docs.sparkSession
    asked = through_table(item_terms(items, item_id, text))
    blocks = max(1, -(-asked.count() // pairs))
    found = None
    for b in range(blocks):
        # Bounded: about ``pairs`` pairs, but that an item's terms stay together.
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if part:
            one = _search_block(docs, part, k, doc_id, text)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    ranked = top_k_per(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, part: list, k: int, doc_id: str, text: str) -> DataFrame:
    words = sorted({bytes(r["term"]) for r in part})
    numbers = {w: i for i, w in enumerate(words)}
    held_by: dict[int, list[int]] = {}
    for r in part:
        held_by.setdefault(r["item_id"], []).append(numbers[bytes(r["term"])])
    wanted = {i: np.array(sorted(t), np.int32) for i, t in held_by.items()}
    rows = through_table(counted(docs, numbers, doc_id, text))
    documents, total = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row for each of the block's terms.
    dfs = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(words), np.int64)
    for r in dfs:
        weights[r["term"]] = weight(documents, r["count"])
    shared = rows.sparkSession.sparkContext.broadcast((weights, wanted))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = shared.value
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in wanted}
        for table in _gathered(batches):
            block = Block(table, weights, documents, total)
            for item, terms in wanted.items():
                best[item] = block.best(terms, k, best[item])
        out = [(item, d, -s) for item, pairs in best.items() for s, d in pairs]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return arrow(rows.filter("doc_id is not null and size(terms) > 0"), each, RESULT)
