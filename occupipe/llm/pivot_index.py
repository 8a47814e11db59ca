"""Exact top-k inner products through a pivot-distance index (operator 3).

A vector x is lifted by one coordinate to the common length M, the longest of all; a query q
is lifted by zero. Then the squared distance of q and x is |q|^2 + M^2 - 2 q.x, so the largest
products are the nearest lifted vectors. Each vector is keyed by its nearest pivot and its
distance to it; the vectors of a pivot, sorted by distance, are cut into rings of about
``RING`` rows, and a ring that equal distances make larger is dealt out in chunks.

A query first searches the ring chunk it lies in. Its k-th score there bounds the distance r
of all that can still enter, so by the triangle inequality only rings that meet
``[d(q, p) - r, d(q, p) + r]`` of some pivot p are searched further; queries of one chunk visit
them together. With too few rows at first, r is infinite and every ring is searched.

The number of pivots grows with the square root of the rows, from ``PIVOTS`` to ``MOST_PIVOTS``,
and with it the sample they are fitted on, ``SAMPLE_PER_PIVOT`` rows each; every row is indexed and
results are exact. Spans and rings meet by equality of pivot and distance bin, so no key holds all
rings of a pivot, and a span that misses all of a pivot's rings is never written.
Scores are exact integers as long as they fit in 64 bits.

Defined results: vectors that are null, hold nulls or non-finite components, or reach 2^63 when
scaled take no part; shorter vectors are padded with zeros; an empty vector scores 0; ties go
to the smaller id; rows that share an id are one candidate by their best score, and a query
never meets its own id; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, never_sent
from occupipe.session import through_table

SAMPLE_PER_PIVOT = 4
SMALLEST_SAMPLE = 4096
PIVOTS = 48
MOST_PIVOTS = 4096
RING = 512
BINS = 256
LEAST_BINS = 16
RING_BINS = 4
CELLS = 1 << 22
QUERY_GROUPS = 64


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        values = np.frombuffer(row, f"<i{row[0]}", offset=1)
        out[i, : len(values)] = values
    return out


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold each of them, after that number of bytes: vectors go to many blocks."""
    most = np.abs(values).max(initial=0)
    size = next((n for n in (1, 2, 4) if most < 2.0 ** (8 * n - 1)), 8)
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products, by floating point where that is exact too."""
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if size < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def packed(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id``, the floors of the scaled components as bytes, their number and length."""
    rows = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("vec_id is not null and x is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, sizes, norms = [], [], [], []
            for vid, x in zip(batch.column("vec_id").to_pylist(), batch.column("x")):
                values = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(all="ignore"):
                    values = np.floor(scale * values)
                if x.values.null_count or not (np.abs(values) < 2.0**63).all():
                    continue
                ids.append(vid)
                out.append(_bytes(values))
                sizes.append(len(values))
                norms.append(float(values @ values))
            arrays = [pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "size", "norm2"])

    return arrow(rows, each, "vec_id bigint, x binary, size int, norm2 double")


class Pivots:
    """Reference points of the lifted space, spread out over a bounded sample."""

    def __init__(self, sample: list, width: int, longest2: float, count: int) -> None:
        self.width, self.longest2 = width, longest2
        base = _matrix([r["x"] for r in sample], width).astype(np.float64)
        points = np.hstack([base, self.lift(base)])
        chosen = [0]
        nearest = self._squares(points, points[:1])[:, 0]
        while len(chosen) < min(count, len(points)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self._squares(points, points[chosen[-1] :][:1])[:, 0])
        # A few rounds of averaging draw the spread-out points into their neighbourhoods.
        self.points = points[chosen]
        for _ in range(4):
            own, _ = self._nearest(points)
            filled, own = np.unique(own, return_inverse=True)
            sums = np.zeros((len(filled), points.shape[1]))
            np.add.at(sums, own, points)
            self.points = sums / np.bincount(own)[:, None]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.longest2 - (x * x).sum(1, keepdims=True)))

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, dist = np.zeros(len(points), np.int64), np.zeros(len(points))
        step = max(1, CELLS // len(self.points))
        for at in range(0, len(points), step):
            far = self._squares(points[at : at + step], self.points)
            own[at : at + step] = far.argmin(1)
            dist[at : at + step] = np.sqrt(far.min(1))
        return own, dist

    def _lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.zeros((len(x), 1)) if query else self.lift(x)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest pivot and its distance, for a bounded number of cells at a time."""
        return self._nearest(self._lifted(x, False))

    def distances(self, x: np.ndarray, query: bool = False, pivot: int | None = None) -> np.ndarray:
        """Distances to all pivots, or to one."""
        points = self.points if pivot is None else self.points[pivot : pivot + 1]
        far = np.sqrt(self._squares(self._lifted(x, query), points))
        return far if pivot is None else far[:, 0]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id; rows that share an id count once."""
    if len(scores) > 4 * k + 64:
        floor = np.partition(scores, len(scores) - 4 * k)[len(scores) - 4 * k]
        few = np.flatnonzero(scores >= floor)
    else:
        few = np.arange(len(scores))
    few = few[np.lexsort((ids[few], -scores[few]))]
    _, first = np.unique(ids[few], return_index=True)
    if len(first) < k and len(few) < len(scores):
        few = np.lexsort((ids, -scores))
        _, first = np.unique(ids[few], return_index=True)
    return few[np.sort(first)][:k]


def _able(scores: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best rows of ``least`` or more, as (query id, place, score); rows that share an id count once."""
    i, j = np.nonzero((scores >= least[:, None]) & (ids[None, :] != q_ids[:, None]))
    s = scores[i, j]
    order = np.lexsort((-s, ids[j], i))
    i, j, s = i[order], j[order], s[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])
    i, j, s = i[first], j[first], s[first]
    order = np.lexsort((ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return q_ids[i[kept]], j[kept], s[kept]


def build_index(rows: DataFrame, pivots: Pivots, ring: int = RING) -> DataFrame:
    """One row per ring chunk: ``block``, ``pivot``, ``lo``, ``hi`` and the ``rows`` in it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, dist = pivots.nearest(_matrix(batch.column("x").to_pylist(), pivots.width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), batch.column("is_query"), pa.array(own.astype(np.int32)), pa.array(dist)],
                names=["vec_id", "x", "is_query", "pivot", "dist"],
            )

    placed = through_table(arrow(rows, place, "vec_id bigint, x binary, is_query boolean, pivot int, dist double"))
    step = max(1e-9, float(np.sqrt(pivots.longest2)) / 1024)
    placed = placed.withColumn("bin", F.floor(F.col("dist") / step))
    bins = placed.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col("pivot").alias("_pivot"), F.col("bin").alias("_bin"),
        F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / ring).alias("ring"),
        F.ceil(F.col("n") / ring).alias("chunks"),
    )
    dealt = placed.join(bins, (F.col("pivot") == F.col("_pivot")) & (F.col("bin") == F.col("_bin")))
    chunk = F.pmod(F.xxhash64("vec_id", "x"), F.col("chunks"))
    dealt = dealt.withColumn("block", F.xxhash64("pivot", "ring", chunk))
    return through_table(
        dealt.groupBy("block").agg(
            F.first("pivot").alias("pivot"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
            F.collect_list(F.struct("vec_id", "x", "is_query")).alias("rows"),
        )
    )


FOUND = "query_id bigint, vec_id bigint, score bigint"
SEEDED = (
    "block bigint, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>, q_ids array<bigint>, "
    "q array<binary>, kth array<double>, spans array<struct<pivot:int,lo:double,hi:double>>"
)
SEEDED_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("found", pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))),
        ("q_ids", pa.list_(pa.int64())),
        ("q", pa.list_(pa.binary())),
        ("kth", pa.list_(pa.float64())),
        ("spans", pa.list_(pa.struct([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))),
    ]
)


def pivots_for(n: int) -> int:
    """Half the square root of the rows, within bounds."""
    return min(MOST_PIVOTS, max(PIVOTS, int(np.sqrt(n) / 2)))


def ring_visits(seeded: DataFrame, blocks: DataFrame, width: float) -> DataFrame:
    """Pairs of ``home`` and ``block`` where a span of the home meets the block's ring.

    Both are spread over the distance bins they touch and joined on pivot and bin. Spans lie
    within their pivot's rings, so a span touches at most the bins that the rings take up.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    bins = lambda lo, hi, name: F.explode(F.sequence(bin_of(lo), bin_of(hi))).alias(name)
    spans = seeded.select(F.col("block").alias("home"), F.explode("spans").alias("span")).select("home", "span.*")
    spans = spans.select("home", F.col("pivot").alias("_pivot"), "lo", "hi", bins("lo", "hi", "_bin"))
    rings = blocks.select("block", "pivot", F.col("lo").alias("ring_lo"), F.col("hi").alias("ring_hi"))
    rings = rings.select("*", bins("ring_lo", "ring_hi", "bin"))
    same = (F.col("pivot") == F.col("_pivot")) & (F.col("bin") == F.col("_bin"))
    met = (F.col("ring_lo") <= F.col("hi")) & (F.col("ring_hi") >= F.col("lo")) & (F.col("home") != F.col("block"))
    return spans.join(never_sent(rings), same & met).select("home", "block").distinct()


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
    n_pivots: int | None = None, ring: int = RING,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` best partners.

    ``is_query`` is a condition on a column named ``vec_id`` that picks the queries.
    """
    spark = vectors.sparkSession
    rows = through_table(packed(vectors, vec_id, vector, scale)).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    width, longest2, n = rows.agg(F.max("size"), F.max("norm2"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    n_pivots = n_pivots or pivots_for(n)
    size = max(SMALLEST_SAMPLE, SAMPLE_PER_PIVOT * n_pivots)
    share = min(1.0, 2.0 * size / n)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) <= share * 1_000_000)
    sample = drawn.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "x").limit(size).select("x").collect()
    if not sample:
        sample = rows.select("x").limit(1).collect()
    pivots = Pivots(sample, width, longest2, n_pivots)
    slack = 1e-6 * (1.0 + float(np.sqrt(longest2)))
    blocks = build_index(rows, pivots, ring)
    # The range of each pivot's rings: one row per pivot.
    ranges = blocks.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("rings")).collect()
    held = np.array([r["pivot"] for r in ranges], np.int64)
    nearest, farthest = np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges])

    def reach(q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distance within which a vector must lie to score ``kth`` or more; infinite without one."""
        left = (q.astype(np.float64) ** 2).sum(1) + longest2 - 2 * kth
        return np.sqrt(np.maximum(0.0, left)) * (1 + 1e-9) + slack

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, members in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                asked = [r for r in members if r["is_query"]]
                if not asked:
                    continue
                ids = np.array([r["vec_id"] for r in members], np.int64)
                x = _matrix([r["x"] for r in members], width)
                q_ids = np.array([r["vec_id"] for r in asked], np.int64)
                q = _matrix([r["x"] for r in asked], width)
                found, kth = [], np.full(len(asked), -np.inf)
                for i, scores in enumerate(products(q, x)):
                    other = np.flatnonzero(ids != q_ids[i])
                    best = other[_best(scores[other], ids[other], k)]
                    found += [{"query_id": int(q_ids[i]), "vec_id": int(ids[j]), "score": int(scores[j])} for j in best]
                    if len(best) == k:
                        kth[i] = scores[best[-1]]
                r = reach(q, kth)[:, None]
                far = pivots.distances(q, query=True)[:, held]
                lo, hi = np.maximum((far - r).min(0), nearest), np.minimum((far + r).max(0), farthest)
                spans = [{"pivot": int(held[j]), "lo": float(lo[j]), "hi": float(hi[j])} for j in np.flatnonzero(lo <= hi)]
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "found": found, "q_ids": q_ids.tolist(), "q": [a["x"] for a in asked],
                      "kth": kth.tolist(), "spans": spans}],
                    schema=SEEDED_ARROW,
                )

    seeded = through_table(
        arrow(blocks, local, SEEDED)
    )
    groups = max(1, -(-seeded.count() // QUERY_GROUPS))
    # A span is written once for each bin that it touches: a few bins a ring are enough.
    bins = min(BINS, max(LEAST_BINS, RING_BINS * sum(r["rings"] for r in ranges) // len(ranges)))
    visits = ring_visits(seeded, blocks, max(1e-9, 2 * float(np.sqrt(longest2)) / bins))
    asked = seeded.select(F.col("block").alias("home"), F.struct("q_ids", "q", "kth").alias("asked"))
    # Dealt by block once, for the groups and for the join with the blocks.
    queued = visits.join(never_sent(asked), "home").repartition("block").groupBy("block", F.pmod(F.xxhash64("home"), F.lit(groups)).alias("_group"))
    queued = queued.agg(F.collect_list("asked").alias("asked"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, visitors, p in zip(batch.column("rows").to_pylist(), batch.column("asked").to_pylist(), batch.column("pivot").to_pylist()):
                ids = np.array([r["vec_id"] for r in members], np.int64)
                x = _matrix([r["x"] for r in members], width)
                own = pivots.distances(x, pivot=p)
                q_ids = np.array([i for v in visitors for i in v["q_ids"]], np.int64)
                kth = np.array([s for v in visitors for s in v["kth"]], np.float64)
                q = _matrix([b for v in visitors for b in v["q"]], width)
                far, r = pivots.distances(q, query=True, pivot=p), reach(q, kth)
                # Within the group, a query stays only if this ring meets its own reach.
                stays = np.flatnonzero((own.min() <= far + r) & (own.max() >= far - r))
                found = [_able(products(q[some], x), ids, q_ids[some], kth[some], k) for some in np.array_split(stays, -(-len(stays) * len(x) // CELLS) or 1)]
                i, j, scores = (np.concatenate(c) for c in zip(*found))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[j]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    later = arrow(blocks.select("block", "pivot", "rows").join(never_sent(queued), "block"), search, FOUND)
    every = later.union(seeded.select(F.inline("found"))).distinct()
    every = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
