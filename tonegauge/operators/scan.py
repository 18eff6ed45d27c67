"""Running totals inside groups along a total order, without sending a group through one task.

Rows are range-partitioned on the whole order, so a group of any size is spread over many slices. Each slice adds up its
own rows as they stream by, the slices are kept as a table, and only the first and the last row of every slice meet on the
driver, where the totals that enter each slice are chained.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonegauge.operators.positions import SLICE, default_slices
from tonegauge.session import settle

# task-side functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Marks of a slice's first row, its last row, and both.
FIRST, LAST = 1, 2


def _differs(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it; NULL equals NULL."""
    shifted = pa.concat_arrays([pa.array([before.as_py() if before is not None else None], column.type), column.slice(0, len(column) - 1)])
    unequal = pc.fill_null(pc.not_equal(column, shifted), False)
    return pc.or_(unequal, pc.xor(column.is_null(), shifted.is_null())).to_numpy(zero_copy_only=False)


class _Total:
    """Running total of one value inside one slice."""

    def __init__(self, group: Sequence[str], value: str, xor: bool):
        self.group, self.value = list(group), value
        self.scan = np.bitwise_xor if xor else np.add
        self.before: list[pa.Scalar] | None = None
        self.total, self.head = np.int64(0), True

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Total up to each row of the batch, and whether the row is of the slice's first group."""
        rows = batch.num_rows
        opens = np.zeros(rows, bool)
        for name, before in zip(self.group, self.before or [None] * len(self.group)):
            opens |= _differs(batch.column(name), before)
        opens[0] = opens[0] if self.before is not None else False
        values = pc.fill_null(batch.column(self.value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        with np.errstate(over="ignore"):
            upto = self.scan.accumulate(values)
            starts = np.flatnonzero(opens)
            # what had been added up before the group of each row began
            number = np.searchsorted(starts, np.arange(rows), "right")
            base = np.concatenate(([0], np.where(starts > 0, upto[starts - 1], 0))).astype(np.int64)[number]
            inside = upto ^ base if self.scan is np.bitwise_xor else upto - base
            inside = np.where(number == 0, self.scan(inside, self.total), inside)
        head = (number == 0) & self.head
        self.before = [batch.column(name)[rows - 1] for name in self.group]
        self.total, self.head = np.int64(inside[-1]), bool(head[-1])
        return inside, head


def running(df: DataFrame, order_by: Sequence[str], totals: Mapping[str, tuple[Sequence[str], str]], xor: bool = False, slices: int | None = None, label: str = "scan") -> DataFrame:
    """Add, for each entry ``name: (group, value)`` of ``totals``, the total of the bigint column ``value`` over the rows
    of the same group up to and with this one, along ``order_by``.

    Rows of a group must be neighbours in the order: each group is a list of columns that come first in it (``order_by``
    may hold columns between them as long as equal groups stay together). NULL values count as zero, NULL keys are a
    group. ``xor`` combines with exclusive or in place of addition. Rows that tie in the order are totalled in any order.
    """
    named, whole = dict(totals), [*df.schema.fields]
    extra = [T.StructField(SLICE, T.IntegerType()), T.StructField("_edge", T.IntegerType())]
    for name in named:
        extra += [T.StructField(name, T.LongType()), T.StructField(f"_head_{name}", T.BooleanType())]
    fields = T.StructType([*whole, *extra])
    target = to_arrow_schema(fields)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        states = {name: _Total(group, value, xor) for name, (group, value) in named.items()}
        held, first = None, True

        def finish(columns: list, last: bool) -> pa.RecordBatch:
            rows = len(columns[0])
            edge = np.zeros(rows, np.int32)
            edge[0] += FIRST * first
            edge[-1] += LAST * last
            columns[len(whole)] = pa.array(np.full(rows, number, np.int32))
            columns[len(whole) + 1] = pa.array(edge)
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:  # one batch is held back, so the last row of the slice is known
                yield finish(held, False)
                first = False
            held = [*batch.columns, None, None]
            for state in states.values():
                total, head = state.step(batch)
                held += [pa.array(total), pa.array(head)]
        if held is not None:
            yield finish(held, True)

    ranged = df.repartitionByRange(slices or default_slices(df), *order_by).sortWithinPartitions(*order_by)
    sliced = settle(ranged.mapInArrow(inside, fields), label)
    return _enter(sliced, named, xor, [f.name for f in whole])


def _enter(sliced: DataFrame, totals: Mapping[str, tuple[Sequence[str], str]], xor: bool, names: list[str]) -> DataFrame:
    """Add to each slice's first group what the slices before it hold of it."""
    groups = list(dict.fromkeys(c for group, _ in totals.values() for c in group))
    flags = [c for name in totals for c in (name, f"_head_{name}")]
    # at most two rows of a slice
    edges = sorted(sliced.where("_edge > 0").select(SLICE, "_edge", *groups, *flags).collect(), key=lambda r: (r[SLICE], r["_edge"] == LAST))
    entering: dict[int, dict[str, int]] = {}
    for name, (group, _) in totals.items():
        key, left = None, 0  # the group left open by the slice before and its total so far
        for row in edges:
            own = tuple(row[c] for c in group)
            if row["_edge"] & FIRST:
                entering.setdefault(row[SLICE], {})[name] = left if own == key else 0
            if row["_edge"] & LAST:
                carried = entering[row[SLICE]][name] if row[f"_head_{name}"] else 0
                key, left = own, row[name] ^ carried if xor else row[name] + carried
    schema = f"{SLICE} int, " + ", ".join(f"`_in_{name}` bigint" for name in totals)
    rows = [(number, *[found[name] for name in totals]) for number, found in entering.items()]
    carried = F.broadcast(sliced.sparkSession.createDataFrame(rows, schema))  # one row per slice

    def whole(name: str) -> Column:
        add = F.when(F.col(f"_head_{name}"), F.col(f"_in_{name}")).otherwise(F.lit(0))
        return (F.col(name).bitwiseXOR(add) if xor else F.col(name) + add).alias(name)

    return sliced.join(carried, SLICE).select(*[F.col(f"`{c}`") for c in names], *[whole(name) for name in totals])
