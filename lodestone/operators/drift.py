"""Moving queries from one embedding model's space into another's by a fitted rotation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relations import drift_rotation


class Rotation:
    """A square matrix R; a vector q of the new model becomes q @ R in the old model's space, in single precision."""

    def __init__(self, matrix):
        m = np.asarray(matrix)
        if m.ndim != 2 or m.shape[0] != m.shape[1]:
            raise ValueError(f"a rotation is square, not {m.shape}")
        if m.dtype not in (np.float32, np.float64):
            raise ValueError(f"a rotation holds floats, not {m.dtype}")
        self.matrix = m.astype(np.float32)

    @classmethod
    def fit(cls, pairs: DataFrame, old: str, new: str, dims: int) -> Rotation:
        """From rows with both models' vectors: centred, orthogonal Procrustes."""
        return cls(drift_rotation(pairs, old, new, dims))

    def adapt(self, query: Sequence[float]) -> list[float]:
        return (np.asarray(query, np.float32) @ self.matrix).tolist()

    def adapt_all(self, vectors: DataFrame, vec_col: str, name: str = "adapted") -> DataFrame:
        """Add the adapted vector to every row, a matrix product a batch; null vectors stay null."""
        matrix = self.matrix

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def turned(v: pd.Series) -> pd.Series:
            known = [x for x in v if x is not None]
            done = iter(np.stack([np.asarray(x, np.float32) for x in known]) @ matrix if known else [])
            return pd.Series([None if x is None else next(done) for x in v], dtype=object)

        return vectors.withColumn(name, turned(F.col(vec_col)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, row) for i, row in enumerate(self.matrix.tolist())]
        spark.createDataFrame(rows, "i int, row array<float>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Rotation:
        rows = sorted((r.i, r.row) for r in spark.read.parquet(path).collect())  # one row a dimension
        if [i for i, _ in rows] != list(range(len(rows))) or any(len(row) != len(rows) for _, row in rows):
            raise ValueError("a rotation is square")
        return cls(np.array([row for _, row in rows], np.float32))
