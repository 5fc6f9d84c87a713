"""Ordered folds over sorted partitions: a state that runs along a key's rows, one row at a time.

Rows are dealt by key and sorted, and then streamed: a key of any size takes the
memory of one batch. It takes one task, though; what can be a window or an
aggregate is not a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, key: list[str], order: list[str], columns: list[str], result: str, kind: str, start: Callable[[], Any], step: Callable[..., tuple[Any, Any]]) -> DataFrame:
    """df with the column result.

    start() is a key's first state; step(state, *columns of a row) is the next
    state and the row's result.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{result}` {kind}").fields])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(names.index(k)).to_pylist() for k in key)))
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in columns))
            out = []
            for own, row in zip(keys, rows):
                if state is None or own != now:
                    now, state = own, start()
                state, value = step(state, *row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _arrow(kind))], names=[*names, result])

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]
