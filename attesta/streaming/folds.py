"""Folds of a table's keys, each in order, many keys a pass."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What follows one key: ``take`` is given its rows in order, ``end`` comes after the last; both give rows of the result, without the key.
Follower = Any


def _pass(batches: Iterator[pa.RecordBatch], start: Callable[[], Follower], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The result of rows (key, ...) that come key by key; one follower and a batch's results are held at a time."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    now, follower = None, None
    for batch in batches:
        out: list[tuple] = []
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if follower is None or key != now:
                if follower is not None:
                    out += [(now, *r) for r in follower.end()]
                now, follower = key, start()
            out += [(now, *r) for r in follower.take(*row)]
        yield batch_of(out)
    if follower is not None:
        yield batch_of([(now, *r) for r in follower.end()])


def in_order(rows: DataFrame, order: list[str], start: Callable[[], Follower], schema: pa.Schema, ddl: str) -> DataFrame:
    """``ddl`` rows of a follower of each key, the first column of ``rows``, given the others in ``order``, nulls last.

    Keys are dealt and sorted by Spark; a task passes over its rows once, so that many small keys cost no more than long ones and a
    key with many rows is never held.
    """
    key = rows.columns[0]
    ordered = rows.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])
    return ordered.mapInArrow(functools.partial(_pass, start=start, schema=schema), ddl)
