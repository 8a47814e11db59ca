"""Ranked lexical search against the plain score of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from occupipe.llm import mask_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        if item is not None and text is not None:
            wanted.setdefault(item, set()).update(TERM.findall(text.translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in counts:
            if d is None or not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, docs, items, **more):
    # A column of the documents clashes with the result's.
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in mask_search.search(d, i, **more).collect())


def made(seed, n_docs, n_items, vocabulary=40):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shares = [1 / (i + 1) for i in range(vocabulary)]
    text = lambda low, high: " ".join(draw.choices(words, shares, k=draw.randint(low, high)))
    return [(i, text(1, 60)) for i in range(n_docs)], [(i, text(1, 90)) for i in range(n_items)]


@pytest.mark.parametrize("block, hits, pairs", [(8192, 1 << 20, 200_000), (7, 50, 30)])
def test_every_rank_by_definition(spark, monkeypatch, block, hits, pairs):
    """Whole, and in many blocks of documents and items, with many ties from copies."""
    import importlib

    docs, items = made(1, 300, 12)
    docs += [(1000 + d, t) for d, t in docs[:60]] + [(d, t) for d, t in docs[:5]]
    if block != 8192:
        # Tasks run in other processes, so the block is set where they see it.
        _, here = docs, importlib.import_module("occupipe.llm.mask_search")
        original = here._gathered

        def small(batches):
            here.BLOCK, here.BLOCK_HITS = block, hits
            return original(batches)

        monkeypatch.setattr(here, "_gathered", small)
    assert run(spark, docs, items, pairs=pairs) == brute(docs, items)


def test_blocks_cut_by_documents_and_hits(monkeypatch):
    """Each row lies in one block, in order, also where one document exceeds a block."""
    import pyarrow as pa

    monkeypatch.setattr(mask_search, "BLOCK", 5)
    monkeypatch.setattr(mask_search, "BLOCK_HITS", 8)
    sizes = [0, 3, 20, 1, 1, 1, 0, 0, 0, 0, 0, 0, 4, 4, 4]
    names = ["doc_id", "n", "terms", "tfs"]
    batch = lambda a, b: pa.RecordBatch.from_arrays(
        [pa.array(range(a, b), pa.int64()), pa.array(sizes[a:b], pa.int64()), pa.array([list(range(s)) for s in sizes[a:b]], pa.list_(pa.int32())),
         pa.array([[1] * s for s in sizes[a:b]], pa.list_(pa.int64()))], names=names)
    blocks = list(mask_search._gathered(iter([batch(0, 4), batch(4, 4), batch(4, 15)])))
    assert [i for t in blocks for i in t.column("doc_id").to_pylist()] == list(range(15))
    assert all(t.num_rows <= 5 for t in blocks) and len(blocks) > 3


def test_awkward_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "..."), (4, "Größe größe GRÖSSE"), (None, "alpha beta"), (6, "alpha"), (7, "ALPHA!alpha-alpha"), (7, "alpha alpha"),
        (8, "beta " * 50_000 + "gamma"), (9, "你好 alpha\x00beta gamma"), (-5, "alpha"), (10, "x_1[y]`z`{q}~"),
    ]
    items = [(1, "alpha"), (1, "gamma"), (2, None), (3, ""), (4, "absent"), (None, "alpha"), (5, "Größe 你好 X Y z Q 1"), (-1, "beta gamma beta")]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {r[0] for r in got} == {1, 5, -1}
    assert run(spark, docs, items, k=1) == brute(docs, items, 1)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "alpha")]) == [] and run(spark, [(1, "alpha")], []) == [] and run(spark, [(1, None)], [(1, "alpha")]) == []


def test_masks_below_the_tenth_score_are_not_evaluated():
    """Of a hundred groups only those whose maximum reaches the floor are scored."""
    import numpy as np
    import pyarrow as pa

    n = 400
    terms = [[0, 1, 2] if i % 40 == 0 else [i % 3] for i in range(n)]
    table = pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "n": pa.array([3] * n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())),
        "tfs": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int64())),
    })
    block = mask_search.Block(table, np.array([10, 20, 30]), n, 3 * n)
    best = block.best(np.array([0, 1, 2], np.int32), 10, [])
    assert [d for _, d in best] == list(range(0, 400, 40))
    assert block.best(np.array([0, 1, 2], np.int32), 10, [(-(10**9), 0)] * 10) == [(-(10**9), 0)] * 10
