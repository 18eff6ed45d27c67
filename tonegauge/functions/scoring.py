"""Small numeric expressions: stance buckets, polarity, tiers, identifiers and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonegauge import constants as K


def stance(score: Column) -> Column:
    return (
        F.when(score < -50, "very_dovish").when(score < -10, "dovish").when(score <= 10, "neutral")
        .when(score <= 50, "hawkish").when(score > 50, "very_hawkish")
    )


def polarity(value: Column, neutral: Column, tie: str = "negative") -> Column:
    """Side of the neutral value; ``tie`` says where equality goes."""
    if tie not in ("negative", "positive"):
        raise ValueError("tie must be 'negative' or 'positive'")
    above = value >= neutral if tie == "positive" else value > neutral
    return F.when(above, "positive").when(value.isNotNull() & neutral.isNotNull(), "negative")


def quality_tier(rate: Column) -> Column:
    return F.when(rate >= 95, "excellent").when(rate >= 85, "good").when(rate.isNotNull(), "low")


def number_in(text: Column, prefix: str, suffix: str = "", strict: bool = False) -> Column:
    """Digits between ``prefix`` and ``suffix`` as BIGINT: NULL on a mismatch, an error if ``strict``."""
    number = F.regexp_extract(text, f"{prefix}(\\d+){suffix}", 1).try_cast("bigint")
    if not strict:
        return number
    message = F.concat(F.lit(f"no number after '{prefix}' in: "), F.coalesce(text, F.lit("NULL")))
    return F.when(number.isNotNull(), number).otherwise(F.raise_error(message).cast("bigint"))


def result_name(chunk_name: Column) -> Column:
    """Name of the result file that answers a chunk's input file."""
    return F.regexp_replace(chunk_name, "_input", "_results")


def cost_per_thousand(tokens_in: Column, tokens_out: Column, prices: tuple[float, float]) -> Column:
    return tokens_in / F.lit(1000.0) * F.lit(prices[0]) + tokens_out / F.lit(1000.0) * F.lit(prices[1])


def cost_per_million(
    tokens_in: Column, tokens_out: Column,
    prices: tuple[float, float] = K.PER_1M, discount: float = K.BATCH_DISCOUNT,
) -> Column:
    full = tokens_in / F.lit(1_000_000.0) * F.lit(prices[0]) + tokens_out / F.lit(1_000_000.0) * F.lit(prices[1])
    return full * F.lit(discount)


def cost_label(cost: Column, cents_suffix: str = "¢") -> Column:
    """``$`` amount with four decimals below a dollar; below a cent the amount is in cents."""
    return (
        F.when(cost < 0.01, F.format_string(f"$%.4f{cents_suffix}", cost * 100))
        .when(cost < 1, F.format_string("$%.4f", cost))
        .otherwise(F.format_string("$%.2f", cost))
    )
