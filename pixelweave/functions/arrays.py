"""Column functions over a class axis held as an array; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    return F.transform(e, lambda v: v / total(e))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def argmax(a: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(c: Column, n: int, eps: float = 0.0) -> Column:
    """`n` slots, 1 at the class index; `eps` is added to every slot."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == c, 1.0).otherwise(0.0) + F.lit(eps))


def type_map_flatten(a: Column) -> Column:
    """One-hot array back to the class index."""
    weighted = F.transform(a, lambda v, i: v * i)
    return total(weighted).cast("int")


def binarize(c: Column) -> Column:
    return (c > 0).cast("int")
