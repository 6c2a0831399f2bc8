"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_norm(a: Column) -> Column:
    """The norm, with 1 for a zero vector."""
    n = norm(a)
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector whose norm is taken once, on the driver."""
    q = np.asarray(query, np.float64)
    n = float(np.linalg.norm(q)) or 1.0
    return dot(a, literal(q / n)) / unit_norm(a)
