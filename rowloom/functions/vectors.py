"""Small dense vectors held in ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def number_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def one_hot_index(index: Column, width: int) -> Column:
    """1.0 at 0-based ``index``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def many_hot(indexes: Column, width: int) -> Column:
    """1.0 at each of the 0-based ``indexes``, an array of bigint."""
    if not width:
        return F.array().cast("array<double>")
    places = F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")
    return F.transform(places, lambda i: F.when(F.array_contains(indexes, i), 1.0).otherwise(0.0))


def argmax(vector: Column) -> Column:
    """0-based position of the largest element; the first one wins a tie."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def bce_with_logits(logits: Column, target: Column) -> Column:
    """Mean over the elements of the cross entropy between sigmoid(logits) and target."""

    def loss(x, y):
        return F.greatest(x, F.lit(0.0)) - x * y + F.ln(F.lit(1.0) + F.exp(-F.abs(x)))

    total = F.aggregate(F.zip_with(logits, target, loss), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(logits)
