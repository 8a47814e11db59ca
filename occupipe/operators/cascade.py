"""Vectors and MLlib models: the level-by-level cascade, baselines and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    PCA,
    HashingTF,
    RegexTokenizer,
    StopWordsRemover,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import fixed_values as fixed
from occupipe.operators.groups import lookup
from occupipe.operators.taxonomy import prefix_hit
from occupipe.session import through_table


def with_vector(df: DataFrame, array: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def text_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Lowercase alphabetic tokens without stop words."""
    tokenizer = RegexTokenizer(inputCol=text, outputCol="_all", pattern=r"\p{L}+", gaps=False)
    remover = StopWordsRemover(inputCol="_all", outputCol=out)
    return remover.transform(tokenizer.transform(df)).drop("_all")


def mean_of_words(df: DataFrame, key: str, tokens: str, vectors: DataFrame, size: int) -> DataFrame:
    """Document vector from a given (word, vector) table; a zero vector if no word is known."""
    rows = df.select(key, F.explode(tokens).alias("word")).join(lookup(vectors), "word")
    sums = rows.groupBy(key).agg(
        F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(size)]).alias("doc_vector")
    )
    zero = F.array_repeat(F.lit(0.0), size)
    return df.select(key).join(sums, key, "left").select(key, F.coalesce("doc_vector", zero).alias("doc_vector"))


def mean_pooling(vectors: Column, mask: Column, size: int) -> Column:
    """Mean of the unmasked token vectors: sum(v * mask) / max(sum(mask), 1e-9)."""
    weight = F.greatest(
        F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-9)
    )
    total = F.aggregate(
        F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m)),
        F.array_repeat(F.lit(0.0), size),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    return F.transform(total, lambda x: x / weight)


def fit_cascade(
    train: DataFrame,
    features: str,
    labels: dict[int, str],
    trees: bool = False,
    max_iter: int = 30,
    seed: int = 1,
    forest: int = 300,
    depth: int = 10,
) -> PipelineModel:
    """Fit one classifier per level; each sees the features and all earlier scores.

    ``labels`` maps a level to its index column. Earlier scores are raw margins for the
    linear form and probabilities for the tree form, which has ``forest`` trees of ``depth``.
    Levels are fitted in turn.
    """
    # The assembler cannot learn a vector's length from a stream, so it is stated.
    size = train.select(features).first()[0].size
    hint = VectorSizeHint(inputCol=features, size=size)
    stages, data = [hint], hint.transform(train)
    for k in sorted(labels):
        earlier = [f"{'proba' if trees else 'raw'}_{j}" for j in sorted(labels) if j < k]
        joined = VectorAssembler(inputCols=[features, *earlier], outputCol=f"in_{k}")
        common = dict(
            featuresCol=f"in_{k}",
            labelCol=labels[k],
            rawPredictionCol=f"raw_{k}",
            probabilityCol=f"proba_{k}",
            predictionCol=f"pred_{k}",
        )
        if trees:
            classifier = RandomForestClassifier(numTrees=forest, maxDepth=depth, seed=seed, **common)
        else:
            classifier = LogisticRegression(
                family="multinomial", maxIter=max_iter, regParam=0.01, aggregationDepth=3, **common
            )
        data = joined.transform(data)
        model = classifier.fit(data)
        data = model.transform(data)
        stages += [joined, model]
    return PipelineModel(stages=stages)


def _with_margins(df: DataFrame, level: int, models: Sequence[GBTClassificationModel]) -> DataFrame:
    """Add ``margins_k``, the classes' margins in index order, and ``pred_k``, the class of the highest."""
    out = df
    for c, model in enumerate(models):
        out = model.setRawPredictionCol(f"_raw_{c}").setProbabilityCol(f"_p_{c}").setPredictionCol(f"_y_{c}").transform(out)
    margins = [F.get(vector_to_array(f"_raw_{c}"), F.lit(1)) for c in range(len(models))]
    if len(models) == 1:
        margins = [-margins[0], margins[0]]
    out = out.withColumn("_margins", F.array(*margins))
    best = F.array_position("_margins", F.array_max("_margins")).cast("double") - 1
    return out.select(*df.columns, array_to_vector("_margins").alias(f"margins_{level}"), best.alias(f"pred_{level}"))


@dataclass
class BoostedCascade:
    """Per level, one boosted binary model for each class; for two classes that of the second one."""

    features: str
    models: dict[int, list[GBTClassificationModel]]

    def transform(self, df: DataFrame) -> DataFrame:
        out, inputs = df, [self.features]
        for k, models in self.models.items():
            out = VectorAssembler(inputCols=inputs, outputCol="_in").transform(out)
            out = _with_margins(out, k, models).drop("_in")
            inputs.append(f"margins_{k}")
        return out


def fit_boosted_cascade(
    rows: DataFrame,
    features: str,
    labels: dict[int, str],
    held: str,
    trees: int = 300,
    depth: int = 10,
    step: float = 0.1,
    tolerance: float = 0.01,
    seed: int = 1,
) -> tuple[BoostedCascade, DataFrame]:
    """Boosted trees, one model per class and level; each level also sees all earlier margins.

    Rows flagged in the boolean column ``held`` are not learnt from: a model stops where its
    loss on them no longer falls by ``tolerance``. Both sides need rows. Also gives the curve:
    level, class, iteration, train and validation loss, one row per tree kept. ``labels`` maps a
    level to its index column; indices run from 0, as many as the taxonomy has classes there.
    """
    top = rows.agg(*[F.max(labels[k]) for k in sorted(labels)]).first()
    cascade, curve, inputs, data = BoostedCascade(features, {}), [], [features], rows
    for k, highest in zip(sorted(labels), top):
        # Written once: earlier margins are not computed again for each class.
        joined = through_table(VectorAssembler(inputCols=inputs, outputCol="_in").transform(data))
        models = []
        for c in [1] if highest <= 1 else range(int(highest) + 1):
            own = joined.withColumn("_own", (F.col(labels[k]) == c).cast("double"))
            model = GBTClassifier(
                featuresCol="_in", labelCol="_own", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed,
                validationIndicatorCol=held, validationTol=tolerance,
            ).fit(own)
            losses = [model.evaluateEachIteration(own.filter(F.col(held) == side)) for side in (False, True)]
            curve += [(k, c, i, *map(float, both)) for i, both in enumerate(zip(*losses))]
            models.append(model)
        cascade.models[k] = models
        data = _with_margins(joined, k, models).drop("_in")
        inputs.append(f"margins_{k}")
    schema = "level int, class int, iteration int, train_loss double, validation_loss double"
    return cascade, rows.sparkSession.createDataFrame(curve, schema)


def fit_flat(train: DataFrame, features: str, label: str, max_iter: int = 30):
    """One multinomial classifier straight to the deepest level."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter, regParam=0.01,
        aggregationDepth=3,
    ).fit(train)


def class_expanded(df: DataFrame, features: str, classes: int, label: str) -> DataFrame:
    """One row per row and class: features joined with that row's class as one-hot.

    The label says whether the class is the row's own; the one-hot never reveals it.
    """
    rows = df.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    one_hot = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.col("class")).cast("double")
    )
    return rows.select(
        *df.columns,
        "class",
        (F.col("class") == F.col(label)).cast("double").alias("is_class"),
        array_to_vector(F.concat(vector_to_array(F.col(features)), one_hot)).alias("expanded"),
    )


def fit_expanded(expanded: DataFrame, positive_weight: float = 20.0, max_iter: int = 30):
    """Binary classifier over class-expanded rows, positives weighted."""
    weighted = expanded.withColumn(
        "weight", F.when(F.col("is_class") == 1, positive_weight).otherwise(1.0)
    )
    return LogisticRegression(
        featuresCol="expanded", labelCol="is_class", weightCol="weight", maxIter=max_iter
    ).fit(weighted)


def two_inputs(df: DataFrame, title_vector: str, text_vector: str, out: str = "features") -> DataFrame:
    """Title vector followed by text vector."""
    return VectorAssembler(inputCols=[title_vector, text_vector], outputCol=out).transform(df)


def linear_head(
    df: DataFrame,
    vector: str,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float],
    mean: Sequence[float],
    scale: Sequence[float],
    out: str = "probabilities",
) -> DataFrame:
    """Softmax of ((x - mean) / scale) W' + b for a given head, in Arrow batches.

    A head is classes times features numbers, a model's size and not the data's.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        tuple(np.asarray(a, dtype="float64") for a in (weights, bias, mean, scale))
    )

    @F.pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        w, b, m, s = shared.value
        logits = ((np.stack(vectors.to_numpy()).astype("float64") - m) / s) @ w.T + b
        exp = np.exp(logits - logits.max(axis=1, keepdims=True))
        return pd.Series(list(exp / exp.sum(axis=1, keepdims=True)))

    return df.withColumn(out, score(F.col(vector)))


def index_labels(encoding: DataFrame, level: int) -> list[str]:
    """A level's codes by index, to label score positions; at most the taxonomy's size."""
    rows = encoding.filter(F.col("level") == level).orderBy("idx").select("code").collect()
    return [r["code"] for r in rows]


def ranked_predictions(scored: DataFrame, level: int, labels: Sequence[str], n: int | None = None) -> Column:
    """Top codes of a level with probabilities, best first: array of (code, proba)."""
    names = F.array(*[F.lit(c) for c in labels])
    best = A.top_n(vector_to_array(F.col(f"proba_{level}")), n or fixed.TOP_N[level], names)
    return F.transform(best, lambda e: F.struct(e["label"].alias("code"), e["p"].alias("proba")))


def ranked_levels(
    scored: DataFrame,
    columns: Sequence[str],
    names: Mapping[int, Sequence[str]],
    label: str | None = None,
    top: Mapping[int, int] | None = None,
) -> DataFrame:
    """Per level the top codes with their probabilities and, given a label, whether its prefix is among them.

    ``scored`` has arrays ``proba_k``; ``names`` lists a level's codes by index. Gives the
    columns named, ``level_k`` as an array of (code, proba), best first, and ``hit_k``.
    """
    def listed(k: int):
        codes = F.array(*[F.lit(c) for c in names[k]])
        best = A.top_n(F.col(f"proba_{k}"), (top or fixed.TOP_N)[k], codes)
        return F.transform(best, lambda e: F.struct(e["label"].alias("code"), e["p"].alias("proba")))

    kept = [*columns, *([label] if label and label not in columns else [])]
    out = scored.select(*kept, *[listed(k).alias(f"level_{k}") for k in names])
    if not label:
        return out
    codes = lambda k: F.transform(f"level_{k}", lambda p: p["code"])
    return out.select("*", *[prefix_hit(codes(k), F.col(label)).alias(f"hit_{k}") for k in names])


def score_levels(
    model: PipelineModel,
    df: DataFrame,
    key: str,
    labels_by_level: dict[int, Sequence[str]],
    label: str | None = None,
    top: dict[int, int] | None = None,
) -> DataFrame:
    """Batch scoring: ``ranked_levels`` of what the model gives."""
    columns = [key, *([label] if label else [])]
    arrays = [vector_to_array(f"proba_{k}").alias(f"proba_{k}") for k in labels_by_level]
    return ranked_levels(model.transform(df).select(*columns, *arrays), columns, labels_by_level, label, top)


def level_losses(scored: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Weighted multi-level loss and the deepest level's accuracy over a scored frame."""
    terms, deepest = None, max(labels)
    for k, label in labels.items():
        p = F.get(vector_to_array(F.col(f"proba_{k}")), F.col(label).cast("int"))
        term = F.avg(-F.ln(F.greatest(p, F.lit(fixed.PROBABILITY_FLOOR)))) * fixed.LEVEL_LOSS_WEIGHTS[k]
        terms = term if terms is None else terms + term
    hit = (F.col(f"pred_{deepest}") == F.col(labels[deepest])).cast("int")
    return scored.agg(terms.alias("loss"), F.avg(hit).alias("accuracy"))


def training_history(model: PipelineModel) -> list[tuple[int, int, float]]:
    """(level, iteration, objective) for each fitted level of a linear cascade."""
    rows, level = [], 0
    for stage in model.stages:
        if hasattr(stage, "hasSummary"):
            level += 1
            if stage.hasSummary:
                rows += [(level, i, float(v)) for i, v in enumerate(stage.summary.objectiveHistory)]
    return rows


def train_and_validation(model: PipelineModel, train: DataFrame, valid: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Loss and accuracy on both sides of a split."""
    sides = [level_losses(model.transform(df), labels).withColumn("side", F.lit(s)) for s, df in (("train", train), ("validation", valid))]
    return sides[0].unionByName(sides[1]).select("side", "loss", "accuracy")


def to_plane(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Principal components for plotting."""
    return PCA(k=k, inputCol=vector, outputCol="_pc").fit(df).transform(df).withColumn(
        "plane", vector_to_array("_pc")
    ).drop("_pc")


def fit_text_baseline(df: DataFrame, text: str, label: str, features: int = 1 << 12, max_iter: int = 20) -> PipelineModel:
    """Bag-of-words classifier: hashed term counts, IDF, logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\p{L}+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=0.01,
                probabilityCol="proba_1", predictionCol="pred_1", rawPredictionCol="raw_1",
            ),
        ]
    ).fit(df)


