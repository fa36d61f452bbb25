"""mapInArrow with the few forms that the operators need."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch, on both sides of the socket; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it sets a bound of its own: rows of text differ too much
    in size for a bound in rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give what a finished task held back to the system; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of bounded bytes; memory is released when a task ends."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def free_name(name: str, *taken: list[str]) -> str:
    """``name``, with underscores behind it until no list has it, whatever the case."""
    have = {c.lower() for names in taken for c in names}
    while name.lower() in have:
        name += "_"
    return name


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with further columns that ``fn`` makes from each batch; the others pass unread, those in ``drop``
    go. A column of ``df`` with the name of a new one is replaced by it."""
    new_names = {f.name.lower() for f in fields}
    gone = {c.lower() for c in drop} | new_names
    stay = [k for k, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    names = [df.columns[k] for k in stay] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *fn(batch)], names)

    return mapped(df, run, T.StructType([*(df.schema.fields[k] for k in stay), *fields]))


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, "object"]]:
    """Tables of whole groups from batches sorted by their first ``n_keys`` integer columns, with the
    numpy positions at which groups start. A group never falls into two tables."""
    import numpy as np

    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table):
        change = np.zeros(max(table.num_rows, 1), bool)
        change[0] = True
        for k in range(n_keys):
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0], batch
        if len(held) > 1 and all(first.column(k)[0] == last.column(k)[last.num_rows - 1] for k in range(n_keys)):
            continue  # one group so far
        table = pa.Table.from_batches(held)
        starts = cut(table)
        if len(starts) > 1:
            end = int(starts[-1])
            yield table.slice(0, end), starts[:-1]
            held = table.slice(end).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, cut(table)
