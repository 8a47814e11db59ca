"""Scoring end to end: models fed in batches, and one saved pipeline from a record's HTML to nested predictions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from occupipe.operators import blocks as B
from occupipe.operators.cascade import fit_cascade, ranked_levels
from occupipe.operators.taxonomy import nested_result
from occupipe.session import through_table

BATCH_ROWS = 512
#: A batch of vectors, one a row, to each level's class probabilities, one row a vector.
Scorer = Callable[[np.ndarray], Mapping[int, np.ndarray]]


def probabilities_in_batches(
    df: DataFrame, vector: str, size: int, load: Callable[[], Scorer], levels: Sequence[int], batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Add ``proba_k``, an array of the classes' probabilities, for each level of a model of any kind.

    ``load`` is called once in each Python worker, so a large model is opened there and is not
    sent with every task; its result then gets ``batch_rows`` vectors of ``size`` numbers at a
    time. A null vector has null probabilities. Works on streams too.
    """
    names = [f"proba_{k}" for k in levels]

    def opened():
        model = load()

        def predict(vectors: np.ndarray) -> dict[str, np.ndarray]:
            found = model(vectors)
            return {f"proba_{k}": np.asarray(found[k], "float64") for k in levels}

        return predict

    kind = StructType([StructField(n, ArrayType(DoubleType())) for n in names])
    scored = predict_batch_udf(opened, return_type=kind, batch_size=batch_rows, input_tensor_shapes=[[size]])
    # The batches hold no nulls: a zero vector stands in for one and its result is dropped.
    filled = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    out = df.withColumn("_scored", scored(filled))
    return out.select(*df.columns, *[F.when(F.col(vector).isNotNull(), F.col("_scored")[n]).alias(n) for n in names])


def softmax_heads(
    weights: Mapping[int, np.ndarray], bias: Mapping[int, np.ndarray], mean: np.ndarray, scale: np.ndarray
) -> Scorer:
    """Per level, softmax of ((x - mean) / scale) W' + b."""
    def score(vectors: np.ndarray) -> dict[int, np.ndarray]:
        x, found = (vectors - mean) / scale, {}
        for k, w in weights.items():
            logits = x @ w.T + bias[k]
            exp = np.exp(logits - logits.max(axis=1, keepdims=True))
            found[k] = exp / exp.sum(axis=1, keepdims=True)
        return found

    return score


class TaskExtractor(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The cleaned task text of an HTML column, as the first stage of a pipeline; a null gives an empty text."""

    lexicon = Param(Params._dummy(), "lexicon", "verbs that open a task", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, lexicon: list[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getInputCol()
        found = B.extract_tasks(df.select(F.struct("*").alias("_row"), F.col(text).alias("_html")), "_html", self.getOrDefault(self.lexicon))
        return found.select("_row.*", F.coalesce("cleaned", F.lit("")).alias(self.getOutputCol()))


def fit_scoring(
    train: DataFrame,
    html: str,
    labels: dict[int, str],
    lexicon: Sequence[str],
    features: int = 1 << 12,
    max_iter: int = 30,
) -> PipelineModel:
    """HTML to scores in one pipeline: task extraction, hashed words weighted by rarity, and the cascade.

    ``labels`` maps a level to its index column. The training texts are extracted once and written.
    """
    extractor = TaskExtractor(inputCol=html, outputCol="tasks", lexicon=list(lexicon))
    texts = through_table(extractor.transform(train.select(html, *labels.values())).drop(html))
    words = RegexTokenizer(inputCol="tasks", outputCol="_words", pattern=r"\p{L}+", gaps=False)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    counted = counts.transform(words.transform(texts))
    rarity = IDF(inputCol="_counts", outputCol="features").fit(counted)
    weighted = through_table(rarity.transform(counted).select("features", *labels.values()))
    cascade = fit_cascade(weighted, "features", labels, max_iter=max_iter)
    return PipelineModel(stages=[extractor, words, counts, rarity, cascade])


def score_records(
    model: PipelineModel,
    records: DataFrame,
    key: str,
    fields: Sequence[str],
    names: Mapping[int, Sequence[str]],
    taxonomy: DataFrame,
    n: int = 10,
) -> DataFrame:
    """Records to nested results: key, fields, the task text, per level its top codes, and the deepest
    level's predictions with titles, descriptions and confidences. The same plan for tables and streams.
    """
    scored = model.transform(records)
    kept = [key, *fields, "tasks"]
    arrays = scored.select(*kept, *[vector_to_array(f"proba_{k}").alias(f"proba_{k}") for k in names])
    ranked = ranked_levels(arrays, kept, names)
    return nested_result(ranked, key, [*fields, "tasks", *[f"level_{k}" for k in names]], f"level_{max(names)}", taxonomy, n)
