"""Prompt rendering, request records, their token counts and the checks on request files."""

from __future__ import annotations

import json
from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.functions.scoring import cost_per_million, cost_per_thousand
from tonegauge.functions.text import clip_to_limit, escaped_length, no_strings, token_estimate
from tonegauge.sources.splits import checked_lines, read_split_lines

# The template is a parameter everywhere; callers with their own wording pass it with the same four slots.
DEFAULT_TEMPLATE = f"""Rate the monetary policy tone of the speech below.

Speaker: {{speaker}}
Institution: {{institution}}
Date: {{date}}

{K.TEXT_MARKER}
{{text}}

{K.TASK_MARKER}
Reply with one JSON object: hawkish_dovish_score from -100 to 100; topics (inflation, growth,
financial_stability, labor_market, international), uncertainty and forward_guidance_strength from
0 to 100; key_sentences, a list of quotes; market_impact (stocks, bonds, currency: rise, fall or
neutral; reasoning); summary."""


def _pieces(template: str) -> list[tuple[str, str | None]]:
    return [(literal, slot) for literal, slot, _, _ in Formatter().parse(template)]


def render_prompt(
    text: Column, speaker: Column, institution: Column, date: Column, template: str = DEFAULT_TEMPLATE,
) -> Column:
    slots = {"text": text, "speaker": speaker, "institution": institution, "date": date}
    parts: list[Column] = []
    for literal, slot in _pieces(template):
        parts += [F.lit(literal)] if literal else []
        parts += [slots[slot].cast("string")] if slot else []
    return F.concat(*parts)


def request_record(custom_id: Column, prompt: Column, profile: str = "full", model: str = K.MODEL_NAME) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(K.SYSTEM_MESSAGE)), message("user", prompt)).alias("messages"),
        F.struct(F.lit(K.RESPONSE_FORMAT).alias("type")).alias("response_format"),
        F.lit(K.TEMPERATURE[profile]).alias("temperature"),
    )
    return F.struct(
        custom_id.alias("custom_id"), F.lit(K.REQUEST_METHOD).alias("method"), F.lit(K.REQUEST_URL).alias("url"),
        body.alias("body"),
    )


def serialized_length(
    custom_id: Column, text: Column, speaker: Column, institution: Column, date: Column,
    template: str = DEFAULT_TEMPLATE, profile: str = "full", model: str = K.MODEL_NAME,
) -> Column:
    """Characters of the ASCII-escaped JSON line, added up from its parts; the line is never built."""
    frame = {
        "custom_id": "", "method": K.REQUEST_METHOD, "url": K.REQUEST_URL,
        "body": {
            "model": model,
            "messages": [{"role": "system", "content": K.SYSTEM_MESSAGE}, {"role": "user", "content": ""}],
            "response_format": {"type": K.RESPONSE_FORMAT}, "temperature": K.TEMPERATURE[profile],
        },
    }
    fixed = len(json.dumps(frame)) + sum(len(json.dumps(literal)) - 2 for literal, _ in _pieces(template))
    slots = {"text": text, "speaker": speaker, "institution": institution, "date": date}
    length = F.lit(fixed) + escaped_length(custom_id)
    for _, slot in _pieces(template):
        if slot:
            length = length + escaped_length(slots[slot].cast("string"))
    return length.cast("bigint")


def build_requests(
    speeches: DataFrame, template: str = DEFAULT_TEMPLATE, profile: str = "full", id_column: str = "speech_id",
    text_column: str = "text", speaker_column: str = "author", institution_column: str = "country",
    date_column: str = "date", model: str = K.MODEL_NAME, keep: Sequence[str] = (), max_text_tokens: int | None = None,
) -> DataFrame:
    """One request per speech with its token counts; rows without text belong to ``without_text``.

    ``keep`` names columns to carry along, such as those that order the requests.

    Missing speakers are named ``Unknown``. Texts are sent whole, unless ``max_text_tokens`` asks to cut those that are
    longer. Tokens are counted on the line with every non-ASCII character escaped, as the packing's budget means it; the
    lines are written unescaped and are no longer than that.
    """
    text = F.col(text_column)
    speaker = F.coalesce(F.col(speaker_column), F.lit("Unknown"))
    institution = F.coalesce(F.col(institution_column), F.lit("Unknown"))
    date = F.coalesce(F.col(date_column).cast("string"), F.lit("Unknown"))
    sent = text if max_text_tokens is None else clip_to_limit(text, max_text_tokens)
    slotted = speeches.where(text.isNotNull()).select(
        F.col(id_column).alias("custom_id"), sent.alias("_text"), speaker.alias("_speaker"),
        institution.alias("_institution"), date.alias("_date"),
        (token_estimate(text) > (K.MAX_TEXT_TOKENS if max_text_tokens is None else max_text_tokens)).alias("over_limit"), *keep,
    )
    slots = [F.col(name) for name in ("_text", "_speaker", "_institution", "_date")]
    rendered = slotted.select(
        *keep, "custom_id", "over_limit", render_prompt(*slots, template).alias("prompt"),
        F.shiftright(serialized_length(F.col("custom_id"), *slots, template, profile, model), 2).alias("tokens"),
    )
    return rendered.select(
        *keep, "custom_id", "prompt", token_estimate(F.col("prompt")).alias("prompt_tokens"), "tokens", "over_limit",
        request_record(F.col("custom_id"), F.col("prompt"), profile, model).alias("request"),
    )


def without_text(speeches: DataFrame, text_column: str = "text") -> DataFrame:
    return speeches.where(F.col(text_column).isNull())


def request_lines(requests: DataFrame, *keep: str) -> DataFrame:
    return requests.select(*keep, F.to_json("request").alias("request"))


def request_statistics(
    requests: DataFrame, tokens: str = "prompt_tokens", output_tokens: int = K.OUTPUT_TOKENS_PER_REQUEST,
) -> DataFrame:
    """Requests, tokens, batch and real-time cost and the difference: one row, also for no requests."""
    totals = requests.agg(
        F.count(F.lit(1)).alias("num_requests"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_input_tokens"),
    ).withColumn("estimated_output_tokens", F.col("num_requests") * output_tokens)
    tokens_in, tokens_out = F.col("total_input_tokens"), F.col("estimated_output_tokens")
    return totals.withColumns({
        "batch_cost_estimate": cost_per_thousand(tokens_in, tokens_out, K.BATCH_PER_1K),
        "realtime_cost_estimate": cost_per_thousand(tokens_in, tokens_out, K.REALTIME_PER_1K),
        "discounted_cost_estimate": cost_per_million(tokens_in, tokens_out),
    }).withColumn("savings", F.col("realtime_cost_estimate") - F.col("batch_cost_estimate"))


def flat_estimates(chunk_totals: DataFrame) -> DataFrame:
    """Flat price per request and a range of minutes per chunk."""
    low, high = K.MINUTES_PER_CHUNK
    return chunk_totals.select(
        "num_chunks", "num_requests",
        (F.col("num_requests") * F.lit(K.FLAT_COST_PER_REQUEST)).alias("estimated_cost"),
        (F.col("num_chunks") * low).alias("minutes_low"), (F.col("num_chunks") * high).alias("minutes_high"),
    )


def request_problem(raw: str = "raw") -> Column:
    """First failing rule of a request line, NULL for a good one: a JSON object with the four request fields."""
    value = F.try_parse_json(F.col(raw))
    problem = F.when(value.isNull(), F.lit("Invalid JSON"))
    for field in K.REQUEST_FIELDS:
        problem = problem.when(F.try_variant_get(value, f"$.{field}", "variant").isNull(), F.lit(f"Missing required field '{field}'"))
    return problem


def request_file_context(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """file_name, line_number and error of every bad line of the request files at ``path``, whatever their size."""
    return checked_lines(read_split_lines(spark, path), request_problem(), size)


def request_file_errors(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines that are no JSON object with the four request fields: first failing rule per line.

    The file is valid iff this frame is empty; every bad line is reported, not just the first.
    """
    checked = lines.withColumn("_value", F.try_parse_json(F.col(raw)))
    absent = F.concat(*[
        F.when(F.try_variant_get("_value", f"$.{field}", "variant").isNull(), F.array(F.lit(field))).otherwise(no_strings())
        for field in K.REQUEST_FIELDS
    ])
    problem = F.when(F.col("_value").isNull(), F.lit("Invalid JSON")).when(
        F.size(absent) > 0, F.concat(F.lit("Missing required field '"), absent[0], F.lit("'"))
    )
    return checked.withColumn("error", problem).where(F.col("error").isNotNull()).drop("_value")
