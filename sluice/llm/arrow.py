"""Batch-wise Arrow maps over selected columns: Spark partitions the work, a task sees one batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship_package


#: Rows of a batch that are Python objects at the same time.
SLICE = 1000


def slices(batch):
    """An Arrow batch or array in short runs of rows, so that a worker's memory doesn't follow the session's batch size."""
    return (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE))


def row_filter(df: DataFrame, column: str, keep: Callable[[list], list]) -> DataFrame:
    """The rows of ``df`` for whose values of ``column`` ``keep`` gives true; other columns pass by, and nothing is shuffled."""
    ship_package(df.sparkSession)

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        out = pa.array([bool(x) for part in slices(values) for x in keep(part.to_pylist())], pa.bool_())
        pa.default_memory_pool().release_unused()
        return out

    return df.where(test(F.col(column)))


def map_columns(df: DataFrame, cols: list, fn: Callable[..., dict], schema: str | StructType, per_task: bool = False) -> DataFrame:
    """Apply ``fn(*lists)``, one list for each column of ``cols``, to every batch; it returns a column for each field.

    ``per_task``: ``fn()`` makes the function, once for each partition, so that it can hold state from batch to batch.
    Columns not named in ``cols`` never leave the JVM, so extra columns and clashing names don't matter.
    """
    ship_package(df.sparkSession)
    inner = df.select(*[c.alias(f"c{i}") if not isinstance(c, str) else df[c].alias(f"c{i}") for i, c in enumerate(cols)])
    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, f = to_arrow_schema(schema), fn() if per_task else fn
        for whole in batches:
            for b in slices(whole):
                got = f(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)
            whole = b = None
            pa.default_memory_pool().release_unused()

    return inner.mapInArrow(run, schema)
