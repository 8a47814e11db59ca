"""Operators without SQL against serial, plain forms of the same rules, written apart from them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from occupipe.llm import bradley_terry, counterfactual, feistel, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean prism quartz ridge stone thorn".split()


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# --- operator 1: a plain minimiser ---------------------------------------------------------


def newton(pairs: np.ndarray, ridge: float) -> np.ndarray:
    """Minimises the mean of log(1 + exp(-difference . w)) + ridge / 2 * |w|^2."""
    w = np.zeros(pairs.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(pairs @ w, -60, 60)))
        slope = -(pairs * p[:, None]).mean(0) + ridge * w
        curve = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def plain_quality(x: np.ndarray, y: np.ndarray, pairs_each: int, seed: int):
    mean, spread = x.mean(0), x.std(0) + 1e-6
    scaled = np.clip((x - mean) / spread, -4, 4)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(seed)
    over = np.r_[np.repeat(good, pairs_each), draw.choice(good, pairs_each * len(bad))]
    under = np.r_[draw.choice(bad, pairs_each * len(good)), np.repeat(bad, pairs_each)]
    w = newton(scaled[over] - scaled[under], 1e-4)
    threshold = np.quantile(scaled @ w, np.mean(y == 0))
    return lambda rows: 1 / (1 + np.exp(-np.clip(np.clip((rows - mean) / spread, -4, 4) @ w - threshold, -40, 40))), w


def test_bradley_terry_weights_equal_a_plain_minimiser(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5))
    y = (x @ [1.0, -0.5, 0, 0.2, 0] + rng.normal(size=120) > 0).astype(int)
    model = bradley_terry.fit(spark, x, y, None, 4, 1)
    _, w = plain_quality(x, y, 4, 1)
    assert np.allclose(model.weights, w, atol=2e-3 * np.abs(w).max())


def test_quality_scores_equal_the_plain_form(spark):
    """The whole operator: held-out rows kept out, every document scored."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        good = rng.random() < 0.5
        text = prose(i, 25).capitalize() + "." if rng.random() < (0.75 if good else 0.3) else prose(i, 12).upper() + " !!"
        rows.append((i, text, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    got = {r["doc_id"]: r["score"] for r in bradley_terry.quality(table.select("doc_id", "text"), table.select("doc_id", "quality"), 3, 1).collect()}
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    measured = lambda some: np.array([bradley_terry.measures(r[1]) for r in some], np.float32).astype(np.float64)
    score, _ = plain_quality(measured(learnt), np.array([r[2] for r in learnt]), bradley_terry.PAIRS_EACH, 1)
    want = score(measured(rows))
    assert len(got) == len(rows) and max(abs(got[r[0]] - s) for r, s in zip(rows, want)) < 0.02


# --- operator 2: serial deficit round-robin ---------------------------------------------------


def serial_packing(rows, sequence: int, window: int, weights):
    tokenizer, queues = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for doc_id, text, source in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), sequence):
            queues[source].append((doc_id, at, ids[at : at + sequence], len(ids)))
    tokens = {s: sum(len(p[2]) for p in q) for s, q in queues.items()}
    weight = tokens if weights is None else {s: weights.get(s, 0.0) for s in queues}
    quantum = {s: max(1, math.floor(weight[s] / sum(weight.values()) * window * sequence + 0.5)) for s in queues}
    order = sorted(queues, key=lambda s: (s is not None, s))
    credit, stream, turn = Counter(), [], 0
    while any(queues.values()):
        for s in order:
            credit[s] += quantum[s]
            while queues[s] and len(queues[s][0][2]) <= credit[s]:
                piece = queues[s].pop(0)
                credit[s] -= len(piece[2])
                stream.append((s, turn, piece))
        turn += 1
    out, at = [], 0
    for s, turn, (doc_id, start, ids, total) in stream:
        while ids:
            part = ids[: sequence - at % sequence]
            out.append((doc_id, s, turn, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), total, at // sequence, at % sequence))
            start, at, ids = start + len(part), at + len(part), ids[len(part) :]
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 2.0}, {"c": 1.0}])
def test_packing_equals_a_serial_round_robin(spark, weights):
    """Order, windows and places, over several tasks; a hot source, null and empty texts, a null source and repeated rows."""
    rng = np.random.default_rng(6)
    rows = [(i, prose(i, int(rng.integers(1, 60))), str(rng.choice(["a", "a", "a", "b", "c"]))) for i in range(60)]
    rows += [(60, None, "a"), (61, "", "b"), (62, prose(62, 700), "c"), (63, prose(63, 30), None), (9, *rows[9][1:]), (None, prose(64, 20), "b")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string, source string")
    got = packing.pack(docs, TOKENIZER, sequence=32, window=4, weights=weights)
    names = ["doc_id", "source", "window_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(serial_packing(rows, 32, 4, weights))


# --- operator 8: numbers permuted one by one --------------------------------------------------

ALL = (1 << 64) - 1


def plain_place(number: int, n: int, seed: int) -> int:
    keys = []
    for _ in range(6):
        seed = (seed + 0x9E3779B97F4A7C15) & ALL
        z = ((seed ^ seed >> 30) * 0xBF58476D1CE4E5B9) & ALL
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & ALL
        keys.append(z ^ z >> 31)
    half = 1
    while 4**half < n:
        half += 1
    while n > 1:
        high, low = divmod(number, 2**half)
        for key in keys:
            z = low ^ key
            z = ((z ^ z >> 33) * 0xFF51AFD7ED558CCD) & ALL
            z = ((z ^ z >> 29) * 0xC4CEB9FE1A85EC53) & ALL
            high, low = low, high ^ (z ^ z >> 32) % 2**half
        number = high * 2**half + low
        if number < n:
            break
    return number


@pytest.mark.parametrize("n", [1, 5, 150])
def test_shards_equal_a_plain_walk(spark, n):
    rows = [(None if i % 31 == 7 else i // 2, None if i % 13 == 5 else prose(i % 40, i % 9)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = [(d, (t or "").encode()) for d, t in rows]
    ordered = sorted(((d is not None, d or 0), zlib.crc32(t), len(t) + 8) for d, t in texts)
    want = Counter()
    for number, ((known, d), crc, size) in enumerate(ordered):
        place = plain_place(number, n, 8)
        want[d if known else None, size, crc, place % 24, place // 24] += 1
    got = feistel.shuffle_into_shards(docs, shards=24, seed=8)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == want


# --- operator 9: a plain minimiser and plain features -------------------------------------------


def test_the_fairness_loss_is_minimised():
    rng = np.random.default_rng(3)
    n, d = 80, 8
    own = [sorted(rng.choice(d, rng.integers(1, 5), replace=False).tolist()) for _ in range(n)]
    other = [sorted({(c + 1) % d if c < 2 else c for c in x}) if min(x) < 2 else None for x in own]
    y = np.array([int(2 in x or (0 in x and rng.random() < 0.7)) for x in own], float)
    dense = lambda lists: np.array([[float(c in (x or [])) for c in range(d)] for x in lists])
    a, moved = dense(own), [i for i, x in enumerate(other) if x is not None]
    change = dense([own[i] for i in moved]) - dense([other[i] for i in moved])
    l1, fairness = 1e-3, 1.0

    def loss(w, b):
        z = a @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + fairness * ((change @ w) ** 2).mean() + l1 * np.abs(w).sum()

    w, b, step = np.zeros(d), 0.0, 0.2
    for _ in range(30_000):
        error = 1 / (1 + np.exp(-(a @ w + b))) - y
        new = w - step * (a.T @ error / n + 2 * fairness * change.T @ (change @ w) / len(moved))
        w, b = np.sign(new) * np.maximum(0, np.abs(new) - step * l1), b - step * error.mean()
    model = counterfactual.fit([str(i) for i in range(d)], y.tolist(), own, other, l1=l1, fairness=fairness)
    found = np.array([model.weights.get(str(i), 0.0) for i in range(d)])
    assert loss(found, model.base) <= loss(w, b) + 1e-4


def test_toxicity_scores_equal_the_plain_form(spark):
    """Features by plain sets of words, their choice by the stated test, and each score as a sum."""
    rng = np.random.default_rng(8)
    rows = [
        (i, f"{prose(i, 12)} {'Groblings!' if toxic else '(pleasant)'} {prose(i + 500, 6)}", int(toxic))
        for i in range(120) for toxic in [bool(rng.random() < 0.4)]
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    docs = table.select("doc_id", "text")
    model = counterfactual.learn(docs, table.select("doc_id", "toxic"), 5, 0)

    def features(text):
        words = {w.strip(counterfactual.EDGES) for w in re.split(r"[ \t\n\r\x0b\x0c]+", (text or "").lower())} - {""}
        return words | {"^" + w[:5] for w in words if len(w) > 5}

    learnt = [(features(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    ones = sum(y for _, y in learnt)
    zeros = len(learnt) - ones
    told = set()
    for f in set().union(*(fs for fs, _ in learnt)):
        hits = [y for fs, y in learnt if f in fs]
        p = len(hits) / len(learnt)
        spread = math.sqrt(max(1e-12, p * (1 - p) * (1 / ones + 1 / zeros)))
        if len(hits) >= 3 and abs(sum(hits) / ones - (len(hits) - sum(hits)) / zeros) / spread >= 3:
            told.add(f)
    assert set(model.weights) <= told and {"groblings", "^grobl", "pleasant", "^pleas"} <= told
    more = spark.createDataFrame([(900, None), (901, ""), (902, "GROBLINGS groblings"), (None, "a pleasant ^pleas")], docs.schema)
    got = counterfactual.score(docs.unionByName(more), model).collect()
    texts = {i: t for i, t, _ in rows} | {900: None, 901: "", 902: "GROBLINGS groblings", None: "a pleasant ^pleas"}
    assert len(got) == 124
    for r in got:
        total = model.base + sum(model.weights.get(f, 0.0) for f in features(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
