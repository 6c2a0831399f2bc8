"""Table functions: one input row to many output rows, in Arrow-fed batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Input rows read from Arrow, and output rows handed on, at once: not a whole batch and all that it makes.
ROWS = 64


def flat_map(df: DataFrame, columns: list[str], schema: str, make: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows of ``make(*values of columns)`` for each row; the work is parallel across rows."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    most = ROWS

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(fields)], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, most):
                rows: list[tuple] = []
                for values in zip(*(c.to_pylist() for c in whole.slice(i, most).columns), strict=True):
                    for r in make(*(None if v is None or v != v else v for v in values)):
                        rows.append(r)
                        if len(rows) >= most:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    return df.select(*columns).mapInArrow(run, schema)
