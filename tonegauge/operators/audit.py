"""Audit of scores against the wording of the scored texts, and the samples shown in its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.functions.once import with_columns_once
from tonegauge.functions.text import excerpt, matched_terms, score_verdict, text_after_marker, until_marker
from tonegauge.operators.joins import lookup
from tonegauge.operators.positions import add_positions


def request_texts(requests: DataFrame) -> DataFrame:
    """Speech text taken back out of each request's user message."""
    content = F.get(F.col("body.messages"), F.lit(1))["content"]
    rest = requests.select(F.col("custom_id").alias("speech_id"), text_after_marker(content).alias("_rest"))
    return with_columns_once(rest, {"speech_text": until_marker(F.col("_rest"))}).drop("_rest")


def assess(
    scored: DataFrame, texts: DataFrame, score: str = "hawkish_dovish_score", key: str = "speech_id",
    hawkish: Sequence[str] = K.HAWKISH_TERMS, dovish: Sequence[str] = K.DOVISH_TERMS, word_boundary: bool = False,
) -> DataFrame:
    """Every scored row with the terms found in its text and the verdict on its score.

    The texts are read where they lie: terms and excerpt, not the texts, take part in the join.
    """
    text = F.col("speech_text")
    read = texts.where(F.length(text) > 0).select(
        key, matched_terms(text, hawkish, word_boundary).alias("hawkish_terms"),
        matched_terms(text, dovish, word_boundary).alias("dovish_terms"), excerpt(text).alias("excerpt"),
    )
    verdict = score_verdict(F.col(score), F.size("hawkish_terms"), F.size("dovish_terms"))
    missing = F.lit("ERROR: Speech not found in batch input file")
    return lookup(scored, read, key).withColumn("assessment", F.when(F.col("found"), verdict).otherwise(missing)).drop("found")


def extreme_rows(
    scored: DataFrame, group: str = "country", score: str = "hawkish_dovish_score",
    order_by: Sequence[str] = ("date", "speech_id"), columns: Sequence[str] = ("speech_id", "date", "hawkish_dovish_score"),
) -> DataFrame:
    """Per group the row with the larger of |maximum| and |minimum|, the minimum when they are equal.

    Among equal scores the first by ``order_by``. Both ends come from one hash aggregate; only the few rows that
    have the chosen score are compared by order.
    """
    kept = scored.where(F.col(score).isNotNull())
    ends = kept.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    ends = ends.select("_g", F.when(F.abs("_hi") > F.abs("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("_end"))
    at_end = kept.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col(score) == F.col("_end")))
    best = at_end.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*order_by)).alias("_row"))
    return best.select(group, *[F.col(f"_row.{c}").alias(c) for c in columns])


def middle_rows(
    scored: DataFrame, group: str = "country", order_by: Sequence[str] = ("date", "speech_id"), key: str = "speech_id",
    low: float = 0.2, high: float = 0.8, seed: int = 42, columns: Sequence[str] = ("speech_id", "date", "hawkish_dovish_score"),
) -> DataFrame:
    """Per group one seeded pick among the rows between the 20 % and the 80 % position.

    The pick is the least seeded hash, among equal ones the least key. Positions come from one range-partitioned order
    over all groups, so a group that holds most rows is still spread over many tasks. The first 60 bits of the hash are
    reduced by a hash aggregate; only the rows that have a group's least ones are compared as text.
    """
    narrow = scored.select(*dict.fromkeys([group, *order_by, key, *columns]))
    placed = add_positions(narrow, [group, *order_by], name="_at")
    spans = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    inside = placed.join(spans.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).where(
        (F.col("_at") - F.col("_first") >= F.floor(F.col("_n") * low)) & (F.col("_at") - F.col("_first") < F.floor(F.col("_n") * high))
    )
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    inside = inside.withColumn("_draw", F.conv(F.substring(draw, 1, 15), 16, 10).cast("bigint"))
    least = inside.groupBy(F.col(group).alias("_h")).agg(F.coalesce(F.min("_draw"), F.lit(-1)).alias("_least"))
    near = inside.join(least, F.col(group).eqNullSafe(F.col("_h")) & (F.coalesce("_draw", F.lit(-1)) == F.col("_least")))
    row = F.struct(*[c for c in columns])
    return near.groupBy(group).agg(F.min_by(row, F.struct(draw, F.col(key))).alias("_row")).select(
        group, *[F.col(f"_row.{c}").alias(c) for c in columns]
    )
