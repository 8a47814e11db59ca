"""Hard negatives by length buckets and sorted coordinate lists (operator 11).

Vectors of similar length form a bucket; a length that many vectors share is dealt out in
buckets of about ``BUCKET`` rows. A bucket holds its vectors, their labels and, for every
coordinate, the order of its direction's values. For an anchor q that asks for products of
t > 0 or more, a bucket whose longest vector is l can be left out if t > |q| l. Otherwise a row
that qualifies has a cosine of t / (|q| l) or more with q, so on each focus coordinate (the
``FOCUS`` largest of q's direction) its value lies in a range. The ranges are looked up in the
sorted lists, their rows are intersected, and what remains is verified by exact products.

Three passes: anchors search the bucket they lie in for rows of their own label, which bounds
their k-th positive from below; blocks of anchors then visit all other buckets in reach for
their positives; and again for the negatives, rows of other labels whose product is between
``low`` percent and 100 percent of a positive's. Each visit of a block and a bucket is a row of
an equi-join on the bucket, so none meets a hot key, and no rows are left out: results are exact.

Defined results: rows with a null id, label or vector, with null or non-finite components, or that reach 2^63
when scaled, take no part; rows that share an id count once, the first by label and
then by the bytes of its vector; shorter vectors are padded with zeros; an empty vector scores 0; ties go to the smaller
id; fewer rows than asked for are all returned; a positive with a negative score has no
negatives; an empty table gives no rows. Scores are exact integers as long as they fit in 64 bits.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, never_sent
from occupipe.operators.groups import top_k_per
from occupipe.session import freed_shuffles, through_table

BUCKET = 2048
ANCHORS = 128
VISITORS = 32
FOCUS = 5
#: Lengths of one bucket differ by this factor at most.
RATIO = 1.05
SLACK = 1e-9
PACKED = "vec_id bigint, label bigint, x binary, length double"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def packed(vectors: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """One row per id that takes part: its label, the floors of its scaled components and their length."""
    rows = vectors.select(
        col(vec_id).cast("long").alias("vec_id"), col(label).cast("long").alias("label"), col(vector).cast("array<double>").alias("x")
    ).dropna()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out, lengths = [], [], []
            for i, x in enumerate(batch.column("x")):
                values = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(all="ignore"):
                    values = np.floor(scale * values)
                if x.values.null_count or not (np.abs(values) < 2.0**63).all():
                    continue
                kept.append(i)
                # Trailing zeros change no product.
                used = np.flatnonzero(values)
                out.append(values[: used[-1] + 1 if len(used) else 0].astype("<i8").tobytes())
                lengths.append(float(np.sqrt(values @ values)))
            rest = batch.select(["vec_id", "label"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary()), pa.array(lengths, pa.float64())], names=["vec_id", "label", "x", "length"])

    row = F.struct("label", "x", "length")
    return arrow(rows, each, PACKED).groupBy("vec_id").agg(F.min(row).alias("r")).select("vec_id", "r.*")


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        values = np.frombuffer(row, "<i8")
        out[i, : len(values)] = values
    return out


def directions(x: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return x / np.where(lengths > 0, lengths, 1.0)[:, None]


class Bucket:
    """Vectors of similar length with their sorted coordinate lists."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.x = np.frombuffer(row["x"], "<i8").reshape(len(self.ids), width)
        self.lists = np.frombuffer(row["lists"], "<u4").reshape(width, len(self.ids))
        self.longest = row["longest"]
        self.sorted = np.take_along_axis(directions(self.x).T, self.lists.astype(np.int64), 1)
        # Products are exact in floating point while they stay below 2^53.
        self.size = float(np.abs(self.x).max(initial=0)) * max(1, width)
        self.floats = self.x.astype(np.float64)

    def products(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * self.size < 2.0**53:
            return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def in_reach(self, q: np.ndarray, q_length: float, least: float) -> np.ndarray:
        """Rows that can have a product of ``least`` or more with q; rows that cannot may be among them."""
        every = np.arange(len(self.ids))
        if not least > 0:
            return every
        if not q_length * self.longest > 0:
            return every[:0]
        cosine = least / (q_length * self.longest) * (1 - SLACK) - SLACK
        if cosine > 1:
            return every[:0]
        if cosine <= 0 or not len(q):
            return every
        direction = q / q_length
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        axis, wide = np.arccos(np.clip(direction[focus], -1, 1)), np.arccos(cosine)
        low = np.cos(np.minimum(np.pi, axis + wide)) - SLACK
        high = np.cos(np.maximum(0.0, axis - wide)) + SLACK
        ranges = [
            self.lists[f, np.searchsorted(self.sorted[f], a, "left") : np.searchsorted(self.sorted[f], b, "right")]
            for f, a, b in zip(focus, low, high)
        ]
        ranges.sort(key=len)
        met = np.zeros(len(self.ids), np.uint8)
        for r in ranges:
            if len(r) == 0:
                return every[:0]
            if len(r) < len(self.ids):
                met[r] += 1
        selective = sum(len(r) < len(self.ids) for r in ranges)
        return np.flatnonzero(met == selective)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    few = np.arange(len(scores))
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= floor)
    return few[np.lexsort((ids[few], -scores[few]))][:k]


BUCKETS = "bucket bigint, ids array<bigint>, labels array<bigint>, x binary, lists binary, longest double, anchors array<boolean>"
BUCKETS_ARROW = pa.schema([
    ("bucket", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("x", pa.binary()), ("lists", pa.binary()),
    ("longest", pa.float64()), ("anchors", pa.list_(pa.bool_())),
])
#: ``least`` is the least product an anchor looks for, null for any; ``home`` the bucket it lies in.
ASKED = "anchor_id bigint, label bigint, q binary, q_length double, least double, home bigint"
SEEDED = f"{ASKED}, found array<struct<other_id:bigint,score:bigint>>"
SEEDED_ARROW = pa.schema([
    ("anchor_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("q_length", pa.float64()), ("least", pa.float64()), ("home", pa.int64()),
    ("found", pa.list_(pa.struct([("other_id", pa.int64()), ("score", pa.int64())]))),
])
POSITIVE = "anchor_id bigint, other_id bigint, score bigint"
NEGATIVE = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"


def _in_buckets(df: DataFrame, each: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of a row, which holds a bucket; written, in small Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = list(zip(*each(batch.slice(i, 1).to_pylist()[0])))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    with freed_shuffles(df.sparkSession):
        return through_table(arrow(df, rows, schema))


def length_bins(rows: DataFrame, bucket: int) -> DataFrame:
    """Per bin of the length its number of buckets and longest vector; doubles have some 15,000 bins at most."""
    return rows.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("chunks"), F.max("length").alias("longest"))


def build_buckets(rows: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """``BUCKETS``: the rows of a bin of the length and, in heavy bins, of one hash of the id."""
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("chunks")).cast("int")
    dealt = rows.join(F.broadcast(bins.select("bin", "chunks")), "bin").groupBy(F.xxhash64("bin", chunk).alias("bucket"))
    grouped = dealt.agg(F.collect_list(F.struct("vec_id", "label", "x", "length", "is_anchor")).alias("rows"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, members in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
                members = sorted(members.as_py(), key=lambda r: r["vec_id"])
                x = matrix([r["x"] for r in members], width)
                order = np.argsort(directions(x).T, axis=1, kind="stable")
                one = {
                    "bucket": number, "ids": [r["vec_id"] for r in members], "labels": [r["label"] for r in members], "x": x.tobytes(),
                    "lists": order.astype("<u4").tobytes(), "longest": max(r["length"] for r in members), "anchors": [r["is_anchor"] for r in members],
                }
                yield pa.RecordBatch.from_pylist([one], schema=BUCKETS_ARROW)

    return through_table(arrow(grouped, each, BUCKETS))


def visits(asked: DataFrame, buckets: DataFrame, bins: list) -> DataFrame:
    """Each bucket with the anchors that visit it: ``VISITORS`` blocks of about ``ANCHORS`` anchors a row."""
    blocks = max(1, -(-asked.count() // ANCHORS))
    # The length below which a vector meets none of the block's anchors.
    need = F.when(F.col("least") > 0, F.col("least") / F.greatest("q_length", F.lit(1e-300))).otherwise(0.0)
    grouped = through_table(
        asked.withColumn("_need", need).groupBy(F.pmod(F.xxhash64("anchor_id", F.lit(7)), F.lit(blocks)).alias("block"))
        .agg(F.min("_need").alias("need"), F.collect_list(F.struct(*asked.columns)).alias("asked"))
    )
    table = F.array(*[F.struct(F.lit(b["bin"]).alias("bin"), F.lit(b["chunks"]).alias("chunks"), F.lit(b["longest"]).alias("longest")) for b in bins])
    reached = F.filter(table, lambda b: b["longest"] * (1 + 1e-6) >= F.col("need"))
    named = F.transform(reached, lambda b: F.transform(F.sequence(F.lit(0), b["chunks"] - 1), lambda c: F.xxhash64(b["bin"], c)))
    pairs = grouped.select("block", "asked", F.explode(F.flatten(named)).alias("bucket"))
    groups = max(1, -(-blocks // VISITORS))
    # Dealt by bucket once, for the groups and for the join with the buckets.
    queued = pairs.repartition("bucket").groupBy("bucket", F.pmod("block", F.lit(groups)).alias("_group")).agg(F.flatten(F.collect_list("asked")).alias("asked"))
    return buckets.join(never_sent(queued), "bucket").drop("_group", "anchors")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, vec_id: str = "vec_id",
    label: str = "label", vector: str = "embedding", bucket: int = BUCKET,
) -> DataFrame:
    """Per anchor and positive, the first ``negatives`` rows of other labels within the positive's range.

    ``is_anchor`` is a condition on a column named ``vec_id`` that picks the anchors. Returns ``RESULT``.
    """
    spark = vectors.sparkSession
    binned = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(RATIO)))).otherwise(-1).cast("int")
    rows = through_table(packed(vectors, vec_id, label, vector, scale).withColumn("bin", binned))
    rows = rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
    widest = rows.agg(F.max(F.octet_length("x"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], RESULT)
    width = max(1, widest // 8)
    bins = through_table(length_bins(rows, bucket))
    buckets, known = build_buckets(rows, bins, width), bins.orderBy("bin").collect()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row, width)
                for i in np.flatnonzero(row["anchors"]).tolist():
                    same = np.flatnonzero(b.labels == b.labels[i])
                    same = same[same != i]
                    scores = b.products(b.x[i], same)
                    best = best_of(scores, b.ids[same], positives)
                    yield pa.RecordBatch.from_pylist([{
                        "anchor_id": int(b.ids[i]), "label": int(b.labels[i]), "q": b.x[i].tobytes(), "q_length": float(np.sqrt((b.floats[i] ** 2).sum())),
                        "least": float(scores[best[-1]]) if len(best) == positives else None, "home": row["bucket"],
                        "found": [{"other_id": int(b.ids[same[j]]), "score": int(scores[j])} for j in best],
                    }], schema=SEEDED_ARROW)

    anchored = buckets.filter(F.exists("anchors", lambda a: a))
    seeded = through_table(arrow(anchored, seed, SEEDED))

    def find_positives(row: dict) -> Iterator[tuple]:
        b = Bucket(row, width)
        for a in row["asked"]:
            if a["home"] == row["bucket"]:
                continue
            least = -np.inf if a["least"] is None else a["least"]
            q = np.frombuffer(a["q"], "<i8")
            able = b.in_reach(q, a["q_length"], least)
            able = able[b.labels[able] == a["label"]]
            scores = b.products(q, able)
            for j in best_of(scores, b.ids[able], positives):
                yield a["anchor_id"], int(b.ids[able[j]]), int(scores[j])

    met = _in_buckets(visits(seeded.drop("found"), buckets, known), find_positives, POSITIVE)
    every = seeded.select("anchor_id", F.inline("found")).unionByName(met)
    best = top_k_per(every, ["anchor_id"], [F.desc("score"), F.asc("other_id")], positives)
    # The range of a positive below 0 is empty.
    wanted = best.filter("score >= 0").groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("other_id").alias("positive_id"), "score")).alias("wanted"), F.min("score").alias("_lowest")
    )
    asked = seeded.drop("found", "least").join(never_sent(wanted), "anchor_id")
    asked = through_table(asked.withColumn("least", F.col("_lowest") * (low / 100) * (1 - SLACK)).drop("_lowest"))

    def find_negatives(row: dict) -> Iterator[tuple]:
        b = Bucket(row, width)
        for a in row["asked"]:
            q = np.frombuffer(a["q"], "<i8")
            able = b.in_reach(q, a["q_length"], a["least"])
            able = able[b.labels[able] != a["label"]]
            scores = b.products(q, able)
            for p in a["wanted"]:
                # low * positive <= 100 * negative <= 100 * positive, in whole numbers.
                within = np.flatnonzero((scores >= -(-low * p["score"] // 100)) & (scores <= p["score"]))
                for j in within[best_of(scores[within], b.ids[able[within]], negatives)]:
                    yield a["anchor_id"], p["positive_id"], int(b.ids[able[j]]), p["score"], int(scores[j])

    found = _in_buckets(visits(asked, buckets, known), find_negatives, NEGATIVE)
    ranked = top_k_per(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
