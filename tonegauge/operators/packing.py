"""Token-bounded greedy chunking along a row order: exact, and parallel over slices of the order.

Whether a row opens a chunk depends on all rows before it. What some rows in a row do is, however, a small step function
of a single number, the tokens already in the chunk left open before them, and step functions compose: each slice is
summarised batch by batch, the summaries are folded upward in groups until one group is left (a prefix scan with as many
levels as there need be), the way down tells every slice how it is entered, and each slice then numbers its chunks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.operators.positions import OFFSET, SLICE, default_slices, ordered_slices
from tonegauge.session import cut_lineage, settle

# the small task-side functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows meant for one slice; steps that are folded in one task.
SLICE_ROWS, FOLDED_STEPS = 1_000_000, 2_000_000
_SUMMARY = "_slice bigint, _low array<bigint>, _out array<bigint>, _opened array<bigint>, _adds array<boolean>"
_ENTRY = "_slice bigint, _carry bigint, _before bigint"


class Steps(NamedTuple):
    """From the tokens carried in (at least ``low``, below the next step's) to the tokens carried out and the chunks opened.

    A step that ``adds`` opens nothing yet: ``out`` tokens join those carried in. Only the first step can.
    """

    low: np.ndarray
    out: np.ndarray
    opened: np.ndarray
    adds: np.ndarray

    def at(self, carry: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.low, carry, side="right")) - 1
        return int(self.out[i]) + (carry if self.adds[i] else 0), int(self.opened[i])


def _joined(parts: Sequence[Steps]) -> Steps:
    """Steps in order, neighbours that do the same made one."""
    low, out, opened, adds = (np.concatenate(column) for column in zip(*parts))
    new = np.ones(len(low), bool)
    new[1:] = (out[1:] != out[:-1]) | (opened[1:] != opened[:-1]) | (adds[1:] != adds[:-1])
    return Steps(low[new], out[new], opened[new], adds[new])


def _constant(low: np.ndarray, out: np.ndarray, opened: np.ndarray) -> Steps:
    return Steps(low, out, opened, np.zeros(len(low), bool))


def _next_openings(total: np.ndarray, limit: int) -> np.ndarray:
    """For a chunk opened at row i, the row that opens the following one (``total`` = prefix sums)."""
    rows = len(total) - 1
    first_over = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return np.maximum(first_over, np.arange(1, rows + 1))


def _summarise(tokens: np.ndarray, limit: int) -> Steps:
    """The steps of some neighbouring rows."""
    total = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    rows = len(tokens)
    hop, opened, last = _next_openings(total, limit), np.ones(rows, dtype=np.int64), np.arange(rows)
    while (inside := np.flatnonzero(hop < rows)).size:
        target = hop[inside]
        opened[inside] += opened[target]
        last[inside] = last[target]
        hop[inside] = hop[target]
    left = total[-1] - total[last]
    parts = [Steps(np.array([0]), total[-1:], np.array([0]), np.array([True]))] if total[-1] <= limit else []
    # the rows at which a carried chunk can overflow, from the last one on
    reachable = np.flatnonzero((total[:-1] <= limit) & (total[1:] > total[:-1]))[::-1]
    parts.append(_constant(np.maximum(limit - total[reachable + 1] + 1, 0), left[reachable], opened[reachable]))
    if total[1] == 0:  # an over-full chunk is closed even by a first row without tokens
        parts.append(_constant(np.array([limit + 1]), left[:1], opened[:1]))
    return _joined(parts)


def _compose(first: Steps, second: Steps) -> Steps:
    """What two neighbours do one after the other."""
    parts, rest = [], 0
    if first.adds[0]:
        rest, more = 1, int(first.out[0])
        end = int(first.low[1]) if len(first.low) > 1 else None
        begin = int(np.searchsorted(second.low, first.low[0] + more, side="right")) - 1
        stop = len(second.low) if end is None else int(np.searchsorted(second.low, end + more, side="left"))
        part = Steps(*(column[begin:stop] for column in second))
        parts.append(Steps(np.maximum(part.low - more, first.low[0]), part.out + np.where(part.adds, more, 0), part.opened + first.opened[0], part.adds))
    out = first.out[rest:]
    at = np.searchsorted(second.low, out, side="right") - 1
    parts.append(_constant(first.low[rest:], second.out[at] + np.where(second.adds[at], out, 0), first.opened[rest:] + second.opened[at]))
    return _joined(parts)


def _steps_of(pdf: pd.DataFrame) -> Iterator[tuple[int, Steps]]:
    """Summaries in the order of their slices."""
    ordered = pdf.sort_values(SLICE)
    for number, *parts, adds in zip(*[ordered[name] for name in (SLICE, "_low", "_out", "_opened", "_adds")]):
        yield int(number), Steps(*[np.asarray(part, np.int64) for part in parts], np.asarray(adds, bool))


def _columns(number: int, steps: Steps) -> pd.DataFrame:
    return pd.DataFrame({SLICE: [number], "_low": [steps.low], "_out": [steps.out], "_opened": [steps.opened], "_adds": [steps.adds]})


def _entries(summaries: DataFrame, count: int, carry: int) -> DataFrame:
    """How every slice is entered: tokens carried in and chunks opened before it."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, steps in _steps_of(pdf):
            whole = steps if whole is None else _compose(whole, steps)
        return _columns(int(key[0]), whole)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held, before, found = int(pdf["_carry"].iloc[0]), int(pdf["_before"].iloc[0]), []
        for number, steps in _steps_of(pdf):
            found.append((number, held, before))
            held, opened = steps.at(held)
            before += opened
        return pd.DataFrame(found, columns=[SLICE, "_carry", "_before"])

    longest = summaries.agg(F.max(F.size("_low"))).first()[0] or 1
    width = int(np.clip(FOLDED_STEPS // longest, 2, 256))
    above = F.expr(f"{SLICE} div {width}L").alias("_above")
    levels = [summaries]
    while count > width:
        levels.append(settle(levels[-1].groupBy(above).applyInPandas(fold, _SUMMARY), "folded"))
        count = -(-count // width)
    entered = None
    for level in reversed(levels):
        grouped = level.withColumn("_above", above)
        if entered is None:
            known = grouped.withColumns({"_carry": F.lit(carry).cast("bigint"), "_before": F.lit(0).cast("bigint")})
        else:
            known = grouped.join(entered.withColumnRenamed(SLICE, "_above"), "_above")
        entered = known.groupBy("_above").applyInPandas(walk, _ENTRY)
    return entered


def greedy_chunks(
    df: DataFrame, order_by: Sequence[str], tokens: str = "tokens", max_tokens: int = 80_000,
    slices: int | None = None,
) -> DataFrame:
    """Add ``chunk_id`` (1-based): a row that would overflow a non-empty chunk opens the next one.

    A row above ``max_tokens`` forms its own chunk. Pass the key, the order and the tokens only and
    join wide columns back by key: the rows are range-partitioned and checkpointed here. ``slices`` follow from the
    number of rows unless given.
    """
    # range partitioning reads its input twice, first for a sample of the keys: count tokens once
    counted = df.withColumn("_tokens", F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))).persist(StorageLevel.DISK_ONLY)
    slices = slices or max(default_slices(df), -(-counted.count() // SLICE_ROWS))
    # a checkpoint keeps partitions and row order, which the numbering below relies on
    sliced = cut_lineage(ordered_slices(counted, order_by, slices))
    counted.unpersist()
    empty_start = max_tokens + 1  # "no open chunk" acts like a chunk that is already over-full

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, number = None, None
        for pdf in batches:
            if len(pdf):
                steps = _summarise(pdf["_tokens"].to_numpy(np.int64), max_tokens)
                whole, number = steps if whole is None else _compose(whole, steps), int(pdf[SLICE].iloc[0])
        if whole is not None:
            yield _columns(number, whole)

    summaries = settle(sliced.select(SLICE, "_tokens").mapInPandas(summarise, _SUMMARY), "summaries")
    entries = _entries(summaries, slices, empty_start)

    plain = [f.name for f in df.schema.fields]
    schema = T.StructType([*df.schema.fields, T.StructField("chunk_id", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = before = None
        for pdf in batches:
            if not len(pdf):
                continue
            if carry is None:
                carry, before = int(pdf["_carry"].iloc[0]), int(pdf["_before"].iloc[0])
            total = np.concatenate(([0], np.cumsum(pdf["_tokens"].to_numpy(np.int64))))
            hop, opens = _next_openings(total, max_tokens), np.zeros(len(pdf), dtype=np.int64)
            row, latest = int(np.searchsorted(total[1:], max_tokens - carry, side="right")), None
            while row < len(pdf):
                opens[row], latest, row = 1, row, int(hop[row])
            numbers = before + np.cumsum(opens)
            yield pdf[plain].assign(chunk_id=numbers)
            carry = int(total[-1] - total[latest]) if latest is not None else carry + int(total[-1])
            before = int(numbers[-1])

    # one row per slice, hence small; a broadcast keeps the slices' rows in place and in order
    entered = sliced.join(F.broadcast(entries), SLICE)
    return entered.drop(OFFSET).mapInPandas(number, schema)


def chunk_statistics(chunked: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Requests and tokens per chunk."""
    return chunked.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("num_requests"), F.sum(tokens).cast("bigint").alias("chunk_tokens")
    )


def chunk_totals(statistics: DataFrame) -> DataFrame:
    return statistics.agg(
        F.count(F.lit(1)).alias("num_chunks"),
        F.coalesce(F.sum("num_requests"), F.lit(0)).cast("bigint").alias("num_requests"),
        F.coalesce(F.sum("chunk_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
