"""Hard negatives against all products of every anchor."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from occupipe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, is_anchor, k=5, low=80, scale=256):
    once = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        whole = tuple(math.floor(scale * v) for v in x)
        while whole and not whole[-1]:
            whole = whole[:-1]
        of = lambda r: (r[0], np.array(r[1], "<i8").tobytes())
        once[i] = min(once.get(i, (label, whole)), (label, whole), key=of)
    out = []
    for a, (label, q) in once.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(u * v for u, v in zip(q, x)), i, other) for i, (other, x) in once.items() if i != a)
        for negated, p, _ in [s for s in scored if s[2] == label][:k]:
            ps = -negated
            able = [(i, -s) for s, i, other in scored if other != label and low * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(able)]
    return sorted(out)


def run(spark, rows, every=10, **more):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % every == 0, **more).collect())


def clustered(seed, n, dims=12, labels=4):
    """Vectors around a few centres, of lengths from 0.1 to 3, with copies under several labels."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    x = centres[draw.integers(0, 6, n)] + 0.3 * draw.normal(size=(n, dims))
    x *= (draw.choice([0.1, 1.0, 1.0, 3.0], n) / np.linalg.norm(x, axis=1))[:, None]
    rows = [(i, x[i].tolist(), int(draw.integers(0, labels)), "x") for i in range(n)]
    return rows + [(n + i, rows[i][1], (rows[i][2] + 1) % labels, "x") for i in range(n // 5)]


@pytest.mark.parametrize("bucket", [2048, 16])
def test_every_negative_by_definition(spark, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "VISITORS", 2)
    rows = clustered(3, 400)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 200 and run(spark, rows, bucket=bucket) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1, ""), (1, [1.0, 0.5], 1, ""), (2, [1.0, 0.5], 2, ""), (3, [1.0, 0.5], 3, ""), (4, [0.9, 0.4], 2, ""), (5, [0.9, 0.4], None, ""),
        (6, None, 2, ""), (7, [1.0, None], 2, ""), (8, [nan, 0.5], 2, ""), (9, [inf, 0.5], 2, ""), (10, [], 1, ""), (11, [], 2, ""), (12, [1.0], 1, ""),
        (20, [-1.0, -0.5], 1, ""), (30, [-1.0, -0.5, 0.0, 2.0], 4, ""), (31, [0.0] * 9, 4, ""), (2, [1.0, 0.5], 2, ""), (3, [0.1, 0.5], 3, ""), (None, [1.0], 1, ""),
        (40, [1e18, 1.0], 5, ""), (-10, [1.0, 0.45], 1, ""),
    ]
    valid = [r for r in rows if r[1] is None or not any(v is not None and math.isfinite(v) and abs(256 * v) >= 2**63 for v in r[1])]
    assert run(spark, rows) == brute(valid, lambda i: i % 10 == 0)


def test_many_equal_rows(spark):
    rows = [(i, [0.5, 0.5], i % 2, "") for i in range(300)]
    assert run(spark, rows, every=50, bucket=32) == brute(rows, lambda i: i % 50 == 0)


def test_large_products_stay_exact(spark):
    draw = np.random.default_rng(8)
    rows = [(i, (1e6 * draw.random(3)).tolist(), i % 3, "") for i in range(60)]
    assert run(spark, rows, scale=1 << 10) == brute(rows, lambda i: i % 10 == 0, scale=1 << 10)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(5, [1.0], 1, "")]) == [] and run(spark, [(10, [1.0], 1, "")]) == []


def test_ranges_keep_every_row_in_reach():
    """The intersected ranges hold all rows of at least the asked product and leave others out."""
    draw = np.random.default_rng(2)
    x = np.floor(256 * clustered_matrix(draw)).astype(np.int64)
    order = np.argsort(hard_negatives.directions(x).T, axis=1, kind="stable")
    longest = float(np.sqrt((x.astype(float) ** 2).sum(1)).max())
    row = {"ids": range(len(x)), "labels": [0] * len(x), "x": x.tobytes(), "lists": order.astype("<u4").tobytes(), "longest": longest}
    bucket, left = hard_negatives.Bucket(row, x.shape[1]), 0
    for q in x[:50]:
        scores = x @ q
        for share in (0.5, 0.8, 0.95):
            least = share * float(scores.max())
            able = bucket.in_reach(q, float(np.sqrt(q @ q)), least)
            assert set(np.flatnonzero(scores >= least)) <= set(able)
            left += len(x) - len(able)
    assert left > 50 * len(x)


def clustered_matrix(draw):
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(0, 12, 600)] + 0.2 * draw.normal(size=(600, 16))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_visitors_are_not_sent_to_the_driver(spark):
    bins = [{"bin": b, "chunks": 2, "longest": 1.0} for b in range(3)]
    asked = spark.range(40).selectExpr("id as anchor_id", "id as label", "cast('x' as binary) as q", "1d as q_length", "0.5d as least", "0L as home")
    buckets = spark.createDataFrame([(0, [True])], "bucket long, anchors array<boolean>")
    plan = hard_negatives.visits(asked, buckets, bins)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
