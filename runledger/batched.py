"""Python steps over Arrow batches: some megabytes of rows at a time, whatever a batch holds and however small its groups are."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import ship

SLICE_BYTES = 1 << 20
#: Of the groups that a step gets together; each row counts ROW_BYTES besides its texts.
GROUPS_BYTES, ROW_BYTES = 4 << 20, 1024
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def release_memory() -> None:
    """Gives freed memory of this process back to the system, Arrow's and, where it can, the C library's: Python workers live on
    between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """The rows of a batch as Python values, up to `most` bytes of texts at a time and one row that goes beyond them."""
    size = np.full(batch.num_rows, 64, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield list(zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True))


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def mapped(df: DataFrame, f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of `f(rows)` for slices of the rows."""
    ship(df.sparkSession)
    out = _arrow(schema)

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                yield _batch(f(rows), out)
            del batch, rows  # else they stay while the next one is read
            release_memory()

    return df.mapInArrow(run, schema)


def over_groups(df: DataFrame, key: str, order: str, f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of `f(groups)` for lists of whole groups (key, rows by `order`, nulls last): up to GROUPS_BYTES of small groups
    together, and one that goes beyond them. Rows don't hold the key."""
    ship(df.sparkSession)
    out = _arrow(schema)
    others = [c for c in df.columns if c != key]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch):
                for k, *row in rows:
                    if not held or held[-1][0] != k:
                        if size >= GROUPS_BYTES:
                            yield _batch(f(held), out)
                            held, size = [], 0
                        held.append((k, []))
                    held[-1][1].append(tuple(row))
                    size += ROW_BYTES + sum(len(x) for x in row if isinstance(x, str))
        if held:
            yield _batch(f(held), out)
        release_memory()

    return df.select(key, *others).repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order)).mapInArrow(run, schema)
