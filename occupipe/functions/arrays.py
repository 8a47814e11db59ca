"""Functions on arrays: ranked lists, reductions and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(array: Column) -> Column:
    total = F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.nullif(F.size(array), F.lit(0))


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def in_first_n(array: Column, value: Column, n: int) -> Column:
    return F.array_contains(first_n(array, n), value)


def rank_of(array: Column, value: Column) -> Column:
    """0-based position of a value; null if absent."""
    return F.nullif(F.array_position(array, value), F.lit(0)) - 1


def parse_list_literal(column: Column) -> Column:
    """``"['a', 'b']"`` as an array of strings."""
    return F.from_json(F.translate(column, "'", '"'), "array<string>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def log2_or_zero(n: Column) -> Column:
    return F.when(n > 0, F.log2(n)).otherwise(F.lit(0.0))


def ranked(scores: Column, labels: Column | None = None) -> Column:
    """Scores as an array of (p, idx, label), best first; ties put the highest index first.

    ``scores`` is an array of numbers, ``labels`` the array of names by the same index.
    """
    def entry(p: Column, i: Column) -> Column:
        name = F.get(labels, i) if labels is not None else i.cast("string")
        return F.struct(p.cast("double").alias("p"), i.alias("idx"), name.alias("label"))

    return F.reverse(F.array_sort(F.transform(scores, entry)))


def top_n(scores: Column, n: int, labels: Column | None = None) -> Column:
    return F.slice(ranked(scores, labels), 1, n)


def argmax(scores: Column) -> Column:
    """0-based index of the highest score; ties take the lowest index."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
