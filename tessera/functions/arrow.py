"""Python functions over columns, sent as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_columns(df: DataFrame, fn: Callable[..., list], schema: StructType | str) -> DataFrame:
    """Rows out of ``fn(*columns) -> list of tuples``, called once for each Arrow batch of ``df``.

    The columns arrive as Python lists; ``fn`` may return any number of tuples in the order of ``schema``.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch(fn(*(c.to_pylist() for c in b.columns)), arrow)

    return df.mapInArrow(run, out)


def map_stream(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[list]], schema: StructType | str) -> DataFrame:
    """Like :func:`map_columns`, for functions that keep state over a whole partition."""
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in fn([c.to_pylist() for c in b.columns] for b in batches):
            yield to_batch(rows, arrow)

    return df.mapInArrow(run, out)


def to_batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)


def scalar(fn: Callable, returns: str, once: bool = False) -> Callable:
    """A column function of a Python function of single values, sent as Arrow batches; made at the first use, as it needs a session.

    With ``once`` the optimizer may not copy the call into later expressions, so its column is computed one time.
    """
    from pyspark.sql import functions as F

    made: dict = {}

    def call(*cols):  # noqa: ANN002, ANN202
        if "udf" not in made:
            made["udf"] = F.udf(fn, returns, useArrow=True)
            if once:
                made["udf"] = made["udf"].asNondeterministic()
        return made["udf"](*cols)

    return call
