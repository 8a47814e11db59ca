"""Benchmark decontamination by the q-gram lemma (operator 7).

Texts are compared in lower case with every run of other signs as one space. A passage of m
characters that stands in a document with k edits at most keeps m - q + 1 - qk of its q-grams,
within k + 1 neighbouring diagonals (document place less passage place). Diagonals are grouped
in bands that overlap by k, so one band holds them all. Bands with that many distinct places
of the passage are aligned within the band, and kept if the alignment needs k edits at most.
No passage within its budget is lost.

The budget is ``error`` of the passage's length. Items longer than ``PASSAGE`` characters are cut
into half-overlapping passages, so a long item is found by any such part of it.

The benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters, which bounds memory;
a larger benchmark costs one more pass over the documents per block, and nothing is left out.

Defined results: null and empty texts hold nothing; items with fewer than ``SHORTEST`` characters
are no evidence and are passed over; an item id or text may be repeated; repeated rows are
each reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, ddl, keyed_text
from occupipe.llm.word_ids import slices

Q = 8
ERROR = 0.1
SHORTEST = 24
PASSAGE = 400
BAND = 64
BITS = 22
BLOCK_CHARS = 8 << 20
OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def places(text: str) -> tuple[str, list[int]]:
    """The normal form, and for each of its characters the place in the text it comes from."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            if OTHER.match(x):
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
            else:
                out.append(x)
                at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` = 8 characters from each place on."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    h, power = chars.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    for width in (1, 2, 4):
        h = h[:-width] * power + h[width:]
        h ^= h >> np.uint64(29)
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
    return h


class Passages:
    """The q-grams of a block of items and where they stand."""

    def __init__(self, items: list[tuple[object, str]], error: float) -> None:
        self.ids, self.texts, self.starts = [], [], []
        for item, text in items:
            whole = normal(text or "")
            cuts = [0] if len(whole) <= PASSAGE else [*range(0, len(whole) - PASSAGE, PASSAGE // 2), len(whole) - PASSAGE]
            for at in cuts:
                passage = whole[at : at + PASSAGE]
                if len(passage) >= SHORTEST:
                    self.ids.append(item)
                    self.texts.append(passage)
                    self.starts.append(at)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        # The budget is held to what leaves one q-gram to count.
        self.budget = np.minimum((sizes * error).astype(np.int64), (sizes - Q) // Q)
        self.least = sizes - Q + 1 - Q * self.budget
        self.longest = int(sizes.max(initial=0))
        each = [grams(points(t)) for t in self.texts]
        hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(e)) for e in each]])
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.known, first = np.unique(hashes[order], return_index=True)
        self.ends = np.append(first, len(order))

    def hits(self, found: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text place, passage and passage place of every shared q-gram."""
        at = np.flatnonzero(seen[(found >> np.uint64(64 - BITS)).astype(np.int64)])
        where = np.searchsorted(self.known, found[at])
        same = self.known[np.minimum(where, len(self.known) - 1)] == found[at]
        at, where = at[same], where[same]
        counts = self.ends[where + 1] - self.ends[where]
        post = np.repeat(self.ends[where] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.owner[post], self.place[post]

    def filter_bits(self) -> np.ndarray:
        seen = np.zeros(1 << BITS, bool)
        seen[(self.known >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return seen


def align(passage: np.ndarray, text: np.ndarray, first: int, diagonals: int) -> tuple[int, int, int]:
    """Fewest edits between the passage and a stretch of the text, and the stretch.

    Cells are kept for ``diagonals`` diagonals from ``first`` on. Each cell holds its edits above
    bit 32 and below them how late its stretch begins, so that the least cell is the best.
    """
    one, base = np.int64(1) << 32, first
    size, m = len(text), len(passage)
    offsets = np.arange(diagonals, dtype=np.int64)
    begins = base + offsets
    far = np.int64(1) << 50
    row = np.where((begins >= 0) & (begins <= size), (np.int64(1) << 31) - begins, far)
    padded = np.full(m + diagonals + 1, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, base), min(size, base + len(padded))
    if hi > lo:
        padded[lo - base : hi - base] = text[lo:hi]
    slope = offsets * one
    for i in range(m):
        step = row + np.where(padded[i : i + diagonals] == passage[i], 0, one)
        step[:-1] = np.minimum(step[:-1], row[1:] + one)
        step[-1] = min(step[-1], far)
        row = np.minimum.accumulate(step - slope) + slope
        row[begins + i + 1 > size] = far
    best = int(row.argmin())
    return int(row[best] >> 32), int((np.int64(1) << 31) - (row[best] & (one - 1))), base + m + best


def regions(texts: list[str], passages: Passages, seen: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, first, end, edits) in normal characters of every region within its budget."""
    if not passages.texts:
        return []
    chars = [points(t) for t in texts]
    gap = np.zeros(Q, np.uint32)
    sizes = np.array([len(c) + Q for c in chars], np.int64)
    begins = np.cumsum(sizes) - sizes
    found = grams(np.concatenate([x for c in chars for x in (c, gap)]))
    at, owner, place = passages.hits(found, seen)
    if not len(at):
        return []
    doc = np.searchsorted(begins, at, "right") - 1
    diagonal = at - begins[doc] - place + passages.longest
    bands = int(diagonal.max()) // BAND + 2
    band = diagonal // BAND
    also = (diagonal % BAND < passages.budget[owner]) & (band > 0)
    key = (doc * len(passages.texts) + owner) * bands
    keys = np.concatenate([key + band, (key + band - 1)[also]])
    # Distinct passage places per band, by sorting: np.unique hashes, which is slower here.
    spots = np.sort(keys * (passages.longest + 1) + np.concatenate([place, place[also]]))
    keys = spots[np.append(True, spots[1:] != spots[:-1])] // (passages.longest + 1)
    runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts, keys = np.diff(np.append(runs, len(keys))), keys[runs]
    which = keys // bands
    kept = counts >= passages.least[which % len(passages.texts)]
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k in keys[kept].tolist():
        d, p = divmod(k // bands, len(passages.texts))
        budget, text, passage = int(passages.budget[p]), texts[d], passages.texts[p]
        first = (k % bands) * BAND - passages.longest
        whole = text.find(passage, max(0, first), max(0, first + BAND + budget + len(passage)))
        if whole >= 0:
            edits, start, end = 0, whole, whole + len(passage)
        else:
            edits, start, end = align(points(passage), chars[d], first - budget, BAND + 3 * budget + 1)
        if edits <= budget:
            out.setdefault((d, p), []).append((edits, start, end))
    kept_regions = []
    for (d, p), found_here in out.items():
        taken: list[tuple[int, int]] = []
        for edits, start, end in sorted(found_here):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                kept_regions.append((d, p, start, end, edits))
    return kept_regions


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of at most about ``BLOCK_CHARS`` characters."""
    items = benchmark.select(col(item_id).alias("item_id"), col(text).alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-2 * total // BLOCK_CHARS) if total > BLOCK_CHARS else 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def collected(block: DataFrame, error: float) -> Passages:
    """One block, bounded by ``item_blocks``, as an index."""
    return Passages(sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str), error)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error: float = ERROR, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per region: ``doc_id``, ``item_id``, ``item_start`` (in the item's normal form),
    ``start`` and ``end`` in the document's characters, and ``edits``."""
    rows, found = keyed_text(docs, doc_id, text), None
    for block in item_blocks(benchmark, item_id, item_text):
        passages = collected(block, error)
        sent = docs.sparkSession.sparkContext.broadcast(passages)
        schema = f"{ddl(rows, 'doc_id')}, {ddl(block, 'item_id')}, item_start int, start int, end int, edits int"

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            seen = own.filter_bits()
            for whole in batches:
                for batch in slices(whole, "text", 4 << 20):
                    texts = batch.column("text").to_pylist()
                    met = regions([normal(t) for t in texts], own, seen)
                    if met:
                        spots = {d: [*places(texts[d])[1]] for d in {m[0] for m in met}}
                        first = [spots[d][a] for d, _, a, _, _ in met]
                        last = [spots[d][b - 1] + 1 for d, _, _, b, _ in met]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([m[0] for m in met])), pa.array([own.ids[m[1]] for m in met]),
                             pa.array([own.starts[m[1]] for m in met], pa.int32()), pa.array(first, pa.int32()),
                             pa.array(last, pa.int32()), pa.array([m[4] for m in met], pa.int32())],
                            names=["doc_id", "item_id", "item_start", "start", "end", "edits"],
                        )

        part = arrow(rows, each, schema)
        found = part if found is None else found.union(part)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no region of any item, with all their columns."""
    schema = ddl(docs, *docs.columns)
    for block in item_blocks(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(collected(block, error))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            seen = own.filter_bits()
            for whole in batches:
                for batch in slices(whole, text, 4 << 20):
                    texts = [normal(t or "") for t in batch.column(text).to_pylist()]
                    clean = np.ones(len(texts), bool)
                    clean[[m[0] for m in regions(texts, own, seen)]] = False
                    yield batch.filter(pa.array(clean))

        docs = arrow(docs, each, schema)
    return docs
