"""Expressions on ARRAY<DOUBLE> vectors and on scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_similarity(left: Column, right: Column) -> Column:
    """A zero vector is similar to nothing: 0."""
    return F.coalesce(F.try_divide(dot(left, right), l2_norm(left) * l2_norm(right)), F.lit(0.0))


def euclidean_distance(left: Column, right: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(left, right, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, x: s + x))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 under a softmax of two logits."""
    return sigmoid(logit1 - logit0)


def argmax_class(logit0: Column, logit1: Column) -> Column:
    return F.when(logit1 > logit0, 1).otherwise(0)


def harmonic_mean(left: Column, right: Column) -> Column:
    return F.try_divide(2 * left * right, left + right)


def decide(score: Column, threshold) -> Column:
    """Strictly above the threshold is a match."""
    return (score > threshold).cast("int")


def linspace(start: float, stop: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included, as i / (n-1) of the span."""
    if n == 1:
        return [float(start)]
    return [start + (stop - start) * i / (n - 1) for i in range(n)]
