"""Response envelopes to flat records; rows that cannot be used are set aside with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.functions.once import with_columns_once

_DOUBLE_PATHS = {
    "hawkish_dovish_score": "$.hawkish_dovish_score",
    **{f"topic_{field}": f"$.topics.{field}" for field in K.TOPIC_FIELDS},
    "uncertainty": "$.uncertainty",
    "forward_guidance_strength": "$.forward_guidance_strength",
}
_STRING_PATHS = {f"market_impact_{field}": f"$.market_impact.{field}" for field in K.IMPACT_FIELDS}
REQUIRED_PATHS = {**_DOUBLE_PATHS, **_STRING_PATHS}


def _get(path: str, as_type: str, content: str = "content") -> Column:
    return F.try_variant_get(content, path, as_type)


def _number(path: str) -> Column:
    """A JSON number (or boolean); a number written as a string is a wrong type, hence NULL."""
    value = _get(path, "variant")
    return F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))


def classify_responses(lines: DataFrame, raw: str = "raw", profile: str = "full") -> DataFrame:
    """Parse each line once: adds ``custom_id``, ``content`` (VARIANT) and ``reason`` (NULL = usable).

    ``full`` accepts absent fields; ``reduced`` sets a row aside unless every score, topic and market
    field is there. Both require status 200.
    """
    if profile not in ("full", "reduced"):
        raise ValueError("profile must be 'full' or 'reduced'")
    opened = lines.withColumn("_envelope", F.try_parse_json(F.col(raw))).withColumns({
        "_id": F.try_variant_get("_envelope", "$.custom_id", "string"),
        "_status": F.try_variant_get("_envelope", "$.response.status_code", "int"),
        "_content": F.try_parse_json(F.try_variant_get("_envelope", "$.response.body.choices[0].message.content", "string")),
    })
    status = F.col("_status")
    is_object = F.schema_of_variant("_content").startswith("OBJECT")
    reason = (
        F.when(F.col("_id").isNull(), F.lit("malformed envelope"))
        .when(status.isNull() | (status != 200), F.concat(F.lit("request failed: "), F.coalesce(status.cast("string"), F.lit("no status"))))
        .when(F.col("_content").isNull() | ~is_object, F.lit("content is not a JSON object"))
    )
    if profile == "reduced":
        absent = F.lit(False)
        for path in REQUIRED_PATHS.values():
            absent = absent | _get(path, "variant", "_content").isNull()
        reason = reason.when(absent, F.lit("missing field"))
    parsed = with_columns_once(opened, {
        "custom_id": F.col("_id"), "status_code": status, "content": F.col("_content"), "reason": reason,
    })
    return parsed.drop("_envelope", "_id", "_status", "_content")


def usable(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull())


def quarantine(classified: DataFrame, raw: str = "raw") -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).select(raw, "custom_id", "reason")


def flatten_content(parsed: DataFrame, profile: str = "full", *keep: str) -> DataFrame:
    """Flat columns plus the native ``key_sentence_list``; a field of the wrong type becomes NULL.

    Reasoning is read inside ``market_impact`` and, failing that, at the top level.
    """
    sentences = _get("$.key_sentences", "array<string>")
    reasoning = F.coalesce(_get("$.market_impact.reasoning", "string"), _get("$.reasoning", "string"))
    summary = _get("$.summary", "string")
    if profile == "reduced":
        reasoning, summary = F.coalesce(reasoning, F.lit("")), F.coalesce(summary, F.lit(""))
    joined = F.coalesce(F.array_join(sentences, "|"), F.lit(""))
    flat = {
        "speech_id": F.col("custom_id"),
        **{name: _number(path) for name, path in _DOUBLE_PATHS.items()},
        **{name: _get(path, "string") for name, path in _STRING_PATHS.items()},
        "market_impact_reasoning": reasoning,
        "summary": summary,
        "key_sentences": joined,
        "key_sentence_list": sentences,
    }
    return parsed.select(*keep, *[column.alias(name) for name, column in flat.items()])


def parse_responses(lines: DataFrame, raw: str = "raw", profile: str = "full") -> DataFrame:
    return flatten_content(usable(classify_responses(lines, raw, profile)), profile)


def split_sentences(joined: Column) -> Column:
    return F.split(joined, r"\|")
