"""Toxicity classifier with counterfactual regularisation (operator 9).

A logistic model over the distinct words of a text and the first letters of its longer words,
of which those that tell the labels apart are used. It is fitted on labelled texts with an L1 penalty and with the squared change of
the score when a text's identity terms are swapped for their counterparts. A group's name then
carries no weight that its counterpart lacks, so neutral mentions of a group are not flagged.

Fitting uses a bounded sample of labelled rows (``limit``); every document is scored by its
whole text, and the score uses the text alone.

Defined results: a null or empty text scores the base rate; without labelled rows of both
kinds every score is the share of label 1 (0 if there are none); repeated rows and null ids
are scored like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, bucket_of, col, ddl, keyed_text
from occupipe.llm.labelled import labelled_sample
from occupipe.llm.word_ids import slices
from occupipe.session import through_table

LIMIT = 8000
FEATURES = 4000
STEM = 5
EDGES = ".,;:!?\"'()[]{}*&$%#|<>-_/\\=+~^`@¡¿«»“”‘’…"

#: Counterparts by swapped terms; a term stands on one side only. Extend by ``pairs``.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians"), ("muslim", "christian"), ("islam", "christianity"), ("jews", "buddhists"),
    ("jewish", "buddhist"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("black", "white"), ("african", "european"), ("asian", "american"), ("immigrants", "citizens"),
    ("immigrant", "citizen"), ("refugees", "locals"), ("old", "young"), ("disabled", "abled"),
    ("blind", "sighted"), ("deaf", "hearing"),
)


def swapped(text: str, pairs=IDENTITY_PAIRS) -> str:
    """The text with each identity term replaced by its counterpart, both ways."""
    other = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    found = re.compile(r"(?<!\w)(" + "|".join(sorted(other, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    return found.sub(lambda m: other[m[0].lower()], text)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts without the marks around them, and which text each is from."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.utf8_trim(parts.flatten(), characters=EDGES)
    return words, np.repeat(np.arange(len(texts)), np.diff(offsets))


def _stems(words: pa.Array) -> pa.Array:
    """The first letters of longer words, marked; null for words that are no longer."""
    stems = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, STEM), "")
    return pc.if_else(pc.greater(pc.utf8_length(words), STEM), stems, pa.scalar(None, pa.string()))


def present(texts: pa.Array, features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which features occur in which texts, each pair once."""
    words, rows = _words(texts)
    pairs = []
    for found in (words, _stems(words)):
        at = pc.index_in(found, value_set=features, skip_nulls=True)
        hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
        code = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs.append(rows[hit] * max(1, len(features)) + code)
    pairs = np.unique(np.concatenate(pairs))
    return pairs // max(1, len(features)), pairs % max(1, len(features))


class Model:
    """Weights by feature (words, and the marked first letters of words), and a base."""

    def __init__(self, weights: dict[str, float], base: float) -> None:
        self.weights, self.base = weights, base

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, codes = present(texts, pa.array(list(self.weights), pa.string()))
        values = np.array(list(self.weights.values()), np.float64)
        total = np.bincount(rows, weights=values[codes], minlength=len(texts)) if len(rows) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.base, -40, 40)))


def telling_features(sample: DataFrame, most: int) -> list[str]:
    """The features whose shares among the two labels differ most surely, of those in 3 texts or more.

    ``sample`` has ``text`` and ``label``. Counts are made where the texts lie.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                words, rows = _words(batch.column("text"))
                labels = batch.column("label").to_numpy(zero_copy_only=False)
                for found in (words, _stems(words)):
                    known = pc.is_valid(found).to_numpy(zero_copy_only=False)
                    coded = found.drop_null().dictionary_encode()
                    size = max(1, len(coded.dictionary))
                    pairs = np.unique(rows[known] * size + coded.indices.to_numpy(zero_copy_only=False))
                    of, code = pairs // size, pairs % size
                    n = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64)
                    ones = np.bincount(code, weights=labels[of], minlength=len(coded.dictionary)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n), pa.array(ones)], names=["feature", "n", "ones"])

    n1, total = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not total or n1 in (0, total):
        return []
    counts = arrow(sample.select("text", "label"), each, "feature string, n bigint, ones bigint").groupBy("feature")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).filter("n >= 3 and feature <> ''")
    pooled = F.col("n") / total
    spread = F.sqrt(F.greatest(F.lit(1e-12), pooled * (1 - pooled) * (1 / n1 + 1 / (total - n1))))
    sure = F.abs(F.col("ones") / n1 - (F.col("n") - F.col("ones")) / (total - n1)) / spread
    told = counts.withColumn("sure", sure).filter("sure >= 3").orderBy(F.desc("sure"), "feature").limit(most)
    return sorted(r["feature"] for r in told.select("feature").collect())


def encoded(sample: DataFrame, names: list[str], pairs) -> DataFrame:
    """``label``, the text's features ``own``, and ``other``, those of its swapped form if that differs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, kind = pa.array(names, pa.string()), pa.list_(pa.int32())

        def lists(texts: pa.Array) -> list[list[int]]:
            rows, codes = present(texts, features)
            return [x.tolist() for x in np.split(codes, np.searchsorted(rows, np.arange(1, len(texts))))] if len(texts) else []

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = batch.column("text").to_pylist()
                changed = [swapped(t, pairs) for t in texts]
                moved = [i for i, t in enumerate(texts) if changed[i].lower() != t.lower()]
                other: list[list[int] | None] = [None] * len(texts)
                for i, x in zip(moved, lists(pa.array([changed[i] for i in moved], pa.string()))):
                    other[i] = x
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("label"), pa.array(lists(batch.column("text")), kind), pa.array(other, kind)],
                    names=["_id", "label", "own", "other"],
                )

    return arrow(sample, each, f"{ddl(sample, '_id')}, label int, own array<int>, other array<int>")


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), sizes), np.array([c for x in lists for c in x], np.int64)


def fit(
    names: list[str], labels: list[int], own: list, other: list, l1: float = 3e-5, fairness: float = 1.0, rounds: int = 300
) -> Model:
    """Minimises log loss + ``fairness`` * mean squared swap change + ``l1`` * absolute weights.

    ``own`` and ``other`` list the features of each text and of its swapped form (None if the
    same). Accelerated proximal gradient, restarted whenever the loss would rise.
    """
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not names:
        return Model({}, base)
    rows, cols = _flat(own)
    moved = [i for i, x in enumerate(other) if x is not None]
    mine, theirs = _flat([own[i] for i in moved]), _flat([other[i] for i in moved])
    c_rows, c_cols = np.concatenate([mine[0], theirs[0]]), np.concatenate([mine[1], theirs[1]])
    sign = np.concatenate([np.ones(len(mine[0])), -np.ones(len(theirs[0]))])
    n, d, m = len(y), len(names), max(1, len(moved))

    def loss_and_slope(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        change = np.bincount(c_rows, weights=sign * w[c_cols], minlength=m)
        slope = np.bincount(cols, weights=error[rows], minlength=d) / n
        slope += 2 * fairness / m * np.bincount(c_cols, weights=sign * change[c_rows], minlength=d)
        loss = np.logaddexp(0, z).mean() - (y * z).mean() + fairness / m * (change @ change)
        return float(loss), slope, float(error.mean())

    w, b, step, momentum = np.zeros(d), base, 8.0, 1.0
    ahead, b_ahead = w, b
    best = loss_and_slope(w, b)[0]
    for _ in range(rounds):
        _, slope, b_slope = loss_and_slope(ahead, b_ahead)
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(0.0, np.abs(new) - step * l1)
        new_b = b_ahead - step * b_slope
        loss = loss_and_slope(new, new_b)[0] + l1 * float(np.abs(new).sum())
        if loss > best:
            if momentum == 1.0:
                step /= 2
            momentum, ahead, b_ahead = 1.0, w, b
            continue
        follow = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, b_ahead = new + (momentum - 1) / follow * (new - w), new_b + (momentum - 1) / follow * (new_b - b)
        w, b, momentum, best = new, new_b, follow, loss
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, b)


def learn(
    docs: DataFrame, labels: DataFrame, parts: int, held: int, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", pairs=IDENTITY_PAIRS, most: int = FEATURES, fairness: float = 1.0,
) -> Model:
    """Fits on ``limit`` labelled documents at most, none from the held-out part.

    The texts stay on the executors; the driver gets each one's list of telling features.
    """
    drawn = labelled_sample(labels, bucket_of(F.col("_id"), parts) != held, label, limit, 9, doc_id)
    rows = keyed_text(docs, doc_id, text).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    # One text per drawn id, should an id be repeated.
    sample = through_table(rows.groupBy("_id").agg(F.max("text").alias("text"), F.max("_label").alias("label")))
    names = telling_features(sample, most)
    known = encoded(sample, names, pairs).toPandas().sort_values("_id")
    return fit(names, known["label"].tolist(), known["own"].tolist(), known["other"].tolist(), fairness=fairness)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, for every row."""
    rows = keyed_text(docs, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.score
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = pa.array(scorer(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "score"])

    return arrow(rows, each, f"{ddl(rows, 'doc_id')}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.score
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                yield batch.filter(pa.array(scorer(batch.column(text)) < threshold))

    return arrow(docs, each, ", ".join(f"`{n}` {t}" for n, t in zip(names, (t for _, t in docs.dtypes))))
