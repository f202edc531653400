"""Dense vectors as arrays; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 if either is missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as if its norm were 1."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def softmax1(l0: Column, l1: Column) -> Column:
    """The second class's probability of two logits."""
    return 1.0 / (1.0 + F.exp(l0 - l1))
