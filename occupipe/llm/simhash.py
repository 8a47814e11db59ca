"""SimHash near-duplicates through pivot distance tables (operator 10).

A fingerprint's row in the pivot table holds its Hamming distances to ``PIVOTS`` reference
fingerprints, over all 64 bits and over each of a few bit segments. Two fingerprints that
differ in r bits at most differ by r at most in every coordinate, and r changed bits leave at
least ``segments - r`` segments untouched, in which all coordinates are equal. So pairs meet
under each choice of so many segments whose coordinates agree; of those that meet, a pair is
discarded when a coordinate over all bits differs by more than r, and the rest are verified.
No linked pair is lost.

Where radii are wide, chance alone would link strangers in a large corpus. ``wide`` therefore
takes 64 further bits from the same shingles and verifies a pair on those too.

Equal fingerprints are one node. A key that many fingerprints share is dealt out in blocks, and
each pair of blocks gives a spanning forest of its links instead of all pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; a null id
is passed over when a component's smallest id is taken; repeated rows stay repeated; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, ddl, free, keyed_text, splitmix
from occupipe.llm.components import components
from occupipe.session import through_table

PIVOTS = 16
BLOCK = 1024
HASH_SEED = 42
CHUNK = 1 << 16


def _again(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    z = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return z ^ (z >> np.uint64(28))


def node_of(fps: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and its further bits."""
    z = (fps ^ (_again(more) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(32))


def fingerprint(text: str, words: int, wide: bool = False) -> int | tuple[int, int]:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased, repeats included.

    ``wide`` gives 64 further bits beside it.
    """
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return (0, 0) if wide else 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        one = xxh64_intdigest(joined, HASH_SEED)
        return (one, int(_again(np.array([one], np.uint64))[0])) if wide else one
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(parts) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    bits = np.zeros(128 if wide else 64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        hashes = np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in spans], "<u8")
        held = np.stack([hashes, _again(hashes)], axis=1) if wide else hashes
        bits += np.unpackbits(held.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    found = np.packbits(bits * 2 > len(starts), bitorder="little").view("<u8").tolist()
    return tuple(found) if wide else found[0]


def fingerprints(docs: DataFrame, words: int, wide: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the fingerprint as a signed long ``fp``, its further bits ``more``, and their ``node``.

    Without ``wide``, ``more`` is 0 and ``node`` the fingerprint itself.
    """
    rows = keyed_text(docs, doc_id, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, wide) for t in batch.column("text")], np.uint64).reshape(-1, 2 if wide else 1)
            fps, more = found[:, 0].copy(), found[:, -1].copy() if wide else np.zeros(len(found), np.uint64)
            node = node_of(fps, more) if wide else fps
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x.view(np.int64)) for x in (fps, more, node)]], names=["doc_id", "fp", "more", "node"]
            )

    return arrow(rows, each, f"{ddl(rows, 'doc_id')}, fp bigint, more bigint, node bigint")


def references(seed: int = 10) -> np.ndarray:
    return np.array(splitmix(seed, PIVOTS), np.uint64)


def segment_masks(segments: int) -> np.ndarray:
    edges = [64 * i // segments for i in range(segments + 1)]
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])], np.uint64)


def segments_for(n: int, radius: int) -> int:
    """Segments enough that a fingerprint meets some 128 strangers at most under a key."""
    segments = radius + 2
    while 64 * (segments - radius) // segments < n.bit_length() - 7 and segments < 16:
        segments += 1
    return segments


def pivot_keys(fps: np.ndarray, segments: int, radius: int) -> np.ndarray:
    """One 64-bit key per fingerprint and choice of segments, from the segments' coordinates."""
    pivots, mult = references(), np.uint64(0x9E3779B97F4A7C15)
    codes = []
    for mask in segment_masks(segments):
        code = np.zeros(len(fps), np.uint64)
        for pivot in pivots:
            code = (code ^ np.bitwise_count((fps ^ pivot) & mask)) * mult
            code ^= code >> np.uint64(31)
        codes.append(code)
    keys = []
    for k, chosen in enumerate(combinations(range(segments), segments - radius)):
        key = np.full(len(fps), k + 1, np.uint64) * mult
        for s in chosen:
            key = (key ^ codes[s]) * mult
            key ^= key >> np.uint64(29)
        keys.append(key)
    return np.stack(keys, axis=1)


def forest(fps: np.ndarray, more: np.ndarray, radius: int, more_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join a block as all its pairs within the radii would."""
    if len(fps) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius and int(more[0] ^ more[1]).bit_count() <= more_radius
        return (np.array([0]), np.array([1])) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, more, table = fps[order], more[order], table[order]
    stop = np.searchsorted(table[:, 0], table[:, 0] + np.int8(radius), "right")
    counts = stop - np.arange(len(fps)) - 1
    one = np.repeat(np.arange(len(fps)), counts)
    two = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + one + 1
    for pivot in range(1, PIVOTS):
        kept = np.abs(table[one, pivot] - table[two, pivot]) <= radius
        one, two = one[kept], two[kept]
    kept = np.bitwise_count(fps[one] ^ fps[two]) <= radius
    one, two = one[kept], two[kept]
    kept = np.bitwise_count(more[one] ^ more[two]) <= more_radius
    one, two = one[kept], two[kept]
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return order[label[tied]], order[tied]


def link_fingerprints(nodes: DataFrame, radius: int, n: int, more_radius: int = 64) -> DataFrame:
    """Links ``a``, ``b`` of nodes with the same components as all pairs within the radii.

    ``nodes`` holds ``n`` distinct rows of ``fp``, ``more`` and ``node``.
    """
    segments = segments_for(n, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pivot_keys(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), segments, radius).view(np.int64)
            held = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), keys.shape[1])) for c in ("fp", "more", "node")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *held], names=["key", "fp", "more", "node"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten(), lists.offsets.to_numpy()
            fps, more, node = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps, more = fps.view(np.uint64), more.view(np.uint64)
            ends: tuple[list, list] = ([node[:0]], [node[:0]])
            for i, j in zip((at - at[0]).tolist(), (at - at[0])[1:].tolist()):
                for side, places in zip(ends, forest(fps[i:j], more[i:j], radius, more_radius)):
                    side.append(node[i:j][places])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in ends], names=["a", "b"])

    keys = arrow(nodes.select("fp", "more", "node"), spread, "key bigint, fp bigint, more bigint, node bigint")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keys.join(shared, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = members.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.groupBy("key", F.least("_mine", "_other").alias("_a"), F.greatest("_mine", "_other").alias("_b"))
    lists = met.agg(F.collect_list(F.struct("fp", "more", "node")).alias("held")).select("held")
    return arrow(lists, tie, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 4, more_radius: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable through links.

    With ``more_radius``, a link also needs the further 64 bits to differ by that many at most.
    """
    marked = through_table(fingerprints(docs, words, more_radius is not None, doc_id, text))
    nodes = through_table(marked.groupBy("node", "fp", "more").agg(F.min("doc_id").alias("first_id")))
    links = link_fingerprints(nodes, radius, nodes.count(), 64 if more_radius is None else more_radius)
    tied = components(links, "a", "b")
    placed = nodes.select("node", "first_id").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(least, "root").select("node", "component_id")
    return marked.join(known, "node").select("doc_id", "fp", "component_id")


def first_of_each(
    docs: DataFrame, words: int = 5, radius: int = 4, more_radius: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without those that have a near-duplicate of smaller id.

    A row whose id is null or repeated stays; all columns are kept.
    """
    found = near_duplicates(docs, words, radius, more_radius, doc_id, text)
    name = free(docs, "_later_id")
    later = found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(name))
    return docs.join(later, col(doc_id) == col(name), "left_anti")
