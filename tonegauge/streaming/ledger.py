"""Job state as keyed state of a stream of chunk events: last write wins, also for events that come late.

A chunk's state is bounded: its latest event and, of all other batches, the one with the latest event. That is enough for
events in any order, because a batch that is overtaken twice cannot become the previous one without a new event.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonegauge.session import settle
from tonegauge.sources.bucketed import latest_of
from tonegauge.streaming.ingest import batch_name, write_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT = "chunk_name string, batch_id string, status string, updated_at timestamp, event_id bigint"
#: States in which a chunk waits for its batch.
WAITING = ("in_progress", "validating")
STATE = "at bigint, id bigint, batch string, status string, other_at bigint, other_id bigint, other string, version bigint"
CURRENT = "chunk_name string, status string, batch_id string, previous_batch_id string, resubmitted boolean, stuck boolean, version bigint"


def _take_in(patience_ms: int, waiting: tuple[str, ...]):
    """Brings a chunk's state up to date and emits it; once more, marked as stuck, when it has waited too long."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        top = ((held[0], held[1]), held[2], held[3]) if held else None
        other = ((held[4], held[5]), held[6]) if held and held[4] is not None else None
        version = held[7] if held else 0
        if not state.hasTimedOut:
            for part in parts:
                for at, number, batch, status in zip(part["at"].tolist(), part["event_id"].tolist(), part["batch_id"], part["status"]):
                    place = (at, number)
                    if top is None or place >= top[0]:
                        if top is not None and batch != top[1]:
                            other = (top[0], top[1])
                        top = (place, batch, status)
                    elif batch != top[1] and (other is None or place > other[0]):
                        other = (place, batch)
            if top[2] in waiting:
                state.setTimeoutDuration(patience_ms)
        state.update((*top[0], top[1], top[2], *(other[0] if other else (None, None)), other[1] if other else None, version + 1))
        previous = other[1] if other else None
        yield pd.DataFrame({
            "chunk_name": [key[0]], "status": [top[2]], "batch_id": [top[1]], "previous_batch_id": [previous],
            "resubmitted": [previous is not None], "stuck": [bool(state.hasTimedOut)], "version": [version + 1],
        })

    return run


def collect_ledger(spark: SparkSession, inbox: str, table: str, checkpoint: str, patience_ms: int = 86_400_000, max_files: int = 1000) -> None:
    """Take in every new Parquet file of chunk events and append the states that changed to ``table``, then stop.

    Events need a chunk, a time and an id; chunks that begin with ``_`` are metadata and events without a time are left out.
    A chunk that stays in progress for ``patience_ms`` of clock time without an event is emitted again, marked as stuck.
    The table is folders of micro-batches, so a repeated batch adds nothing; ``current_states`` reads it.
    """
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).parquet(inbox)
    kept = events.where("chunk_name IS NOT NULL AND NOT startswith(chunk_name, '_') AND updated_at IS NOT NULL AND event_id IS NOT NULL")
    places = kept.select("chunk_name", "batch_id", "status", F.unix_micros("updated_at").alias("at"), "event_id")
    states = places.groupBy("chunk_name").applyInPandasWithState(
        _take_in(patience_ms, WAITING), CURRENT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout,
    )

    def put(rows: DataFrame, number: int) -> None:
        write_batch(settle(rows, "states"), table, batch_name(rows, number))

    # timeouts by the clock would otherwise ask for one more batch without data for ever
    conf, name = spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        query = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def current_states(spark: SparkSession, table: str) -> DataFrame:
    """The latest state of every chunk."""
    states = spark.read.schema(CURRENT).parquet(table)
    return latest_of(states, "chunk_name", "version", ["status", "batch_id", "previous_batch_id", "resubmitted", "stuck"])
