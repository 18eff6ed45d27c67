"""The scoring stage as a plug-in: requests in, response envelopes out.

A scorer is a function from the prompt column to a column of JSON answers; it stays in the JVM. A user's function
over pandas Series of prompts is taken by ``score_with_function`` and sees slices of Arrow batches inside the tasks.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.constants import DOVISH_TERMS, HAWKISH_TERMS, SCORE_RANGE, TASK_MARKER, TEXT_MARKER, TOPIC_FIELDS
from tonegauge.functions.text import matched_terms

# the task-side functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Scorer = Callable[[Column], Column]
BatchScorer = Callable[[pd.Series], pd.Series]
#: Bytes of the prompts that are Python objects at a time; a longer prompt goes alone.
SLICE_BYTES = 1 << 22


def _envelopes(answered: DataFrame) -> DataFrame:
    choice = F.struct(F.struct(F.col("answer").alias("content")).alias("message"))
    response = F.struct(F.lit(200).alias("status_code"), F.struct(F.array(choice).alias("choices")).alias("body"))
    return answered.select("custom_id", response.alias("response"))


def score_requests(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """One response envelope per request; expects columns ``custom_id`` and ``prompt``."""
    return _envelopes(requests.select("custom_id", scorer(F.col("prompt")).alias("answer")))


def score_with_function(requests: DataFrame, scorer: BatchScorer) -> DataFrame:
    """Like ``score_requests``, with a Python function over slices of Arrow batches: prompts of ``SLICE_BYTES`` at a time.

    What pandas keeps in cycles (a Series whose ``.str`` was used refers to itself) is collected after every slice; the
    prompts would else pile up until the collector happens to count enough objects.
    """

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        names, prompts = (column.to_pandas() for column in part.columns)
        pdf = pd.DataFrame({"custom_id": names, "answer": scorer(prompts)})
        return pa.RecordBatch.from_arrays([pa.Array.from_pandas(pdf[c], type=pa.string()) for c in pdf], names=list(pdf))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
            for first, end in zip(cuts, cuts[1:]):
                yield scored(batch.slice(first, end - first))
                gc.collect(1)  # the young objects, which are few
            gc.collect()

    answered = requests.select("custom_id", "prompt").mapInArrow(answer, "custom_id string, answer string")
    return _envelopes(answered)


def envelope_lines(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(F.to_json(F.struct("custom_id", "response")).alias("raw"))


def keyword_scorer(
    hawkish: tuple[str, ...] = HAWKISH_TERMS, dovish: tuple[str, ...] = DOVISH_TERMS, step: int = 20,
    start: str = TEXT_MARKER, end: str = TASK_MARKER,
) -> Scorer:
    """Deterministic stand-in for a model: ``step`` points per distinct term, clipped to the score range."""

    def score(prompt: Column) -> Column:
        # between the first start marker and the first end marker after it; nothing without the start
        behind = F.when(F.contains(prompt, F.lit(start)), F.substring(prompt, F.locate(start, prompt) + F.lit(len(start)), F.length(prompt)))
        text = F.coalesce(F.substring_index(behind, end, 1), F.lit(""))
        up, down = (F.size(matched_terms(text, terms)) for terms in (hawkish, dovish))
        points = F.least(F.greatest((up - down) * step, F.lit(SCORE_RANGE[0])), F.lit(SCORE_RANGE[1])).cast("int")
        move = F.when(points == 0, "neutral").when(points > 0, "rise").otherwise("fall")
        topic = F.least(F.lit(100), 10 * (up + down))
        return F.to_json(F.struct(
            points.alias("hawkish_dovish_score"), F.struct(*[topic.alias(field) for field in TOPIC_FIELDS]).alias("topics"),
            F.lit(50).alias("uncertainty"), F.least(F.lit(100), 10 * up).alias("forward_guidance_strength"),
            F.array(F.concat(up.cast("string"), F.lit(" hawkish and "), down.cast("string"), F.lit(" dovish terms"))).alias("key_sentences"),
            F.struct(move.alias("stocks"), move.alias("bonds"), move.alias("currency"), F.lit("keyword balance").alias("reasoning")).alias("market_impact"),
            F.concat(F.lit("Keyword balance "), (up - down).cast("string")).alias("summary"),
        ))

    return score
