"""The end-to-end jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators.audit import assess, extreme_rows, middle_rows
from tonegauge.operators.calendar import common_end as latest_day
from tonegauge.operators.calendar import fill_calendar
from tonegauge.operators.indices import daily_indices
from tonegauge.operators.ingest import split_by_date
from tonegauge.operators.joins import join_by_key, join_by_position
from tonegauge.operators.packing import greedy_chunks
from tonegauge.operators.parse import classify_responses, flatten_content, quarantine, usable
from tonegauge.operators.requests import DEFAULT_TEMPLATE, build_requests, request_lines, without_text
from tonegauge.operators.profile import score_distribution
from tonegauge.operators.validate import batch_summary, error_histogram, invalid_sample, validate
from tonegauge.session import cut_lineage, settle
from tonegauge.sources.writers import write_chunks


class Requests(NamedTuple):
    packed: DataFrame
    set_aside: DataFrame


class Responses(NamedTuple):
    sentiment: DataFrame
    validated: DataFrame
    quarantined: DataFrame


def index_job(prepared: DataFrame, keys: Sequence[str] = ("country",), common_end: bool = False) -> DataFrame:
    """Prepared records to a calendar-complete daily index."""
    daily = daily_indices(prepared, keys)
    if not common_end:
        return fill_calendar(daily, keys)
    daily = cut_lineage(daily)  # days, read twice: for the last one and for the calendar
    return fill_calendar(daily, keys, end=latest_day(daily))


def request_job(
    speeches: DataFrame, path: str, order_by: Sequence[str], profile: str = "full",
    template: str = DEFAULT_TEMPLATE, id_column: str = "speech_id", max_tokens: int | None = None, max_text_tokens: int | None = None,
) -> Requests:
    """Speeches to chunk files under the token budget: id, position-free chunk and tokens of each request, and the rows
    set aside because they have no text. Ids that are NULL or not unique are an error.

    Only ids, order and token counts are ordered and packed. The texts are scanned once for the
    counts and once for the lines that are written.
    """
    names = [f"_order_{i}" for i in range(len(order_by))]
    ordered = speeches.withColumns({name: F.col(column) for name, column in zip(names, order_by)})
    with_text = ordered.where(F.col("text").isNotNull())
    known = with_text.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n"))
    wrong = known.where("id IS NULL OR n > 1").agg(F.count("*").alias("n"), F.min("id").alias("id")).first()
    if wrong["n"]:
        raise ValueError(f"request ids must be given and unique: {wrong['n']} are not, such as {wrong['id']}")
    requests = build_requests(ordered, template, profile, id_column, keep=names, max_text_tokens=max_text_tokens)
    packed = cut_lineage(greedy_chunks(requests.select("custom_id", "tokens", *names), names, "tokens", max_tokens or K.CHUNK_TOKENS[profile]))
    lines = request_lines(requests, "custom_id", *names).join(packed.select("custom_id", "chunk_id"), "custom_id")
    write_chunks(lines, path, order=names)
    return Requests(packed.select("custom_id", "chunk_id", "tokens"), without_text(speeches))


def response_job(lines: DataFrame, profile: str = "full") -> Responses:
    """Raw response lines to flat records, validated records and the rows set aside.

    The classified rows feed three outputs, so they are written once instead of parsed three times;
    each output then reads its own columns. Raw lines are only kept where they were set aside.
    """
    origin = [name for name in ("chunk_number", "file_name") if name in lines.columns]
    parsed = classify_responses(lines.select("raw", *origin), profile=profile)
    aside_only = F.when(F.col("reason").isNotNull(), F.col("raw"))
    classified = settle(parsed.withColumn("raw", aside_only), "classified")
    good = usable(classified)
    return Responses(flatten_content(good, profile), validate(good, profile), quarantine(classified))


def prepare_job(speeches: DataFrame, sentiment: DataFrame, order_by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prepared records, rows without a readable date): positional with ``order_by``, else by speech id."""
    columns = ["date", "author", "country", "title"]
    if order_by:
        joined = join_by_position(speeches, sentiment, order_by, columns)
    else:
        joined = join_by_key(speeches.select("speech_id", *columns), sentiment)
    return split_by_date(joined)


def validation_report(lines: DataFrame, order_by: Sequence[str] = ("custom_id",), profile: str = "full", rows: int = 5) -> DataFrame:
    """One nested row: totals and tier, message kinds with their counts, first invalid records, distribution of each score.

    The three lists are as short as there are rules, as the sample asked for, and as there are scores.
    """
    good = settle(usable(classify_responses(lines, profile=profile)), "usable")
    checked = validate(good, profile)
    summary = batch_summary(checked).select(F.struct("*").alias("summary"))
    kinds = error_histogram(checked).agg(F.sort_array(F.collect_list(F.struct((-F.col("occurrences")).alias("least"), "error_type", "occurrences"))).alias("l"))
    kinds = kinds.select(F.transform("l", lambda x: F.struct(x["error_type"].alias("error_type"), x["occurrences"].alias("occurrences"))).alias("errors"))
    sample = invalid_sample(checked, order_by, rows=rows).agg(F.sort_array(F.collect_list(F.struct("custom_id", "errors"))).alias("invalid_sample"))
    scores = score_distribution(flatten_content(good, profile)).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("distributions"))
    report = summary  # four frames of one row each
    for part in (kinds, sample, scores):
        report = report.withColumn("_one", F.lit(1)).join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return report


def score_audit(scored: DataFrame, texts: DataFrame, group: str = "country", score: str = "hawkish_dovish_score", **options) -> DataFrame:
    """Per group the extreme and the mid-range row, each looked up, searched for terms and assessed; ``options`` go to ``assess``."""
    extreme = extreme_rows(scored, group, score=score).withColumn("sample", F.lit("extreme"))
    middle = middle_rows(scored, group).withColumn("sample", F.lit("middle"))
    return assess(extreme.unionByName(middle), texts, score, **options)
