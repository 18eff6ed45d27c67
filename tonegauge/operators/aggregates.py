"""Aggregates that users write in Python, in two phases: rows become states where they lie, states are merged."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

# task-side functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "_state"
#: Rows, and bytes, that a task gathers before it sorts them by group: a state takes in many rows at a time.
GATHER_ROWS, GATHER_BYTES = 1 << 19, 1 << 26


class Aggregate(Protocol):
    """What a user gives. States must be picklable and small: they are all that is shuffled."""

    def start(self) -> Any: ...

    def update(self, state: Any, columns: Mapping[str, pd.Series]) -> Any:
        """Take in some rows of one group."""

    def merge(self, one: Any, other: Any) -> Any:
        """States of different rows of one group, in any order."""

    def finish(self, state: Any) -> Any: ...


def _by_value(aggregate: Aggregate) -> bytes:
    """The user's object with its class, so workers need not have the module it comes from."""
    module = sys.modules[type(aggregate).__module__]
    if module.__name__ == "__main__" or module.__name__ in cloudpickle.cloudpickle.list_registry_pickle_by_value():
        return cloudpickle.dumps(aggregate)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(aggregate)
    finally:
        cloudpickle.cloudpickle.unregister_pickle_by_value(module)


def _places(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their groups, as they came inside a group, and where each group begins."""
    code = np.zeros(table.num_rows, np.int64)
    for i in range(keys):
        column = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def aggregate_by(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], aggregate: Aggregate, result: str, name: str = "value", groups: int = 50_000) -> DataFrame:
    """One row per group: the keys and ``name``, of the DDL type ``result``.

    Rows are updated into states inside the tasks that read them, ``GATHER_ROWS`` of them at a time; a task holds at most
    ``groups`` states and lets them go when there are more. Only states cross the network, and a group of any size reaches its merging
    task as a few states from each task. Keys may be NULL. No row: no group.
    """
    keys, inputs = list(keys), list(inputs)
    kinds = [df.schema[key] for key in keys]
    states = T.StructType([*kinds, T.StructField(STATE, T.BinaryType())])
    final = T.StructType([*kinds, T.StructField(name, _parse_datatype_string(result))])
    arrow_keys = [to_arrow_type(kind.dataType) for kind in kinds]
    arrow_result = to_arrow_type(final[name].dataType)
    shipped = _by_value(aggregate)

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aggregate, held = pickle.loads(shipped), {}

        def let_go() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(arrow_keys)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], names=[*keys, STATE])
            held.clear()
            return made

        def take(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(gathered)
            gathered.clear()
            order, begins = _places(table, len(keys))
            table = table.take(pa.array(order))
            values = table.select([len(keys) + i for i in range(len(inputs))]).rename_columns(inputs).to_pandas()
            columns = {c: values[c] for c in inputs}
            heads = table.take(pa.array(begins))
            names = list(zip(*[heads.column(i).to_pylist() for i in range(len(keys))])) if keys else [()]
            for group, first, end in zip(names, begins.tolist(), [*begins[1:].tolist(), len(order)]):
                held[group] = aggregate.update(held[group] if group in held else aggregate.start(), {c: v.iloc[first:end] for c, v in columns.items()})
                if len(held) >= groups:
                    yield let_go()

        gathered, rows, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gathered.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= GATHER_ROWS or size >= GATHER_BYTES:
                yield from take(gathered)
                rows = size = 0
        if gathered:
            yield from take(gathered)
        if held:
            yield let_go()

    def merged(part: pa.Table) -> pa.Table:
        aggregate, state = pickle.loads(shipped), None
        for packed in part.column(STATE):
            one = pickle.loads(packed.as_py())
            state = one if state is None else aggregate.merge(state, one)
        columns = [part.column(key).slice(0, 1).combine_chunks() for key in keys]
        return pa.table([*columns, pa.array([aggregate.finish(state)], arrow_result)], names=[*keys, name])

    partial = df.select(*keys, *[df[c].alias(f"_in{i}") for i, c in enumerate(inputs)]).mapInArrow(updated, states)
    return partial.groupBy(*keys).applyInArrow(merged, final)
