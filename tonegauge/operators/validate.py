"""Rules on scored records (VARIANT), per-row error lists and batch-level quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.functions.once import with_columns_once
from tonegauge.functions.scoring import quality_tier


PATHS = (
    *K.TOP_FIELDS, *[f"topics.{field}" for field in K.TOPIC_FIELDS], *[f"market_impact.{field}" for field in K.MARKET_FIELDS],
)


def _column(kind: str, path: str) -> str:
    return f"_{kind}_{path.replace('.', '_')}"


def _value(path: str) -> str:
    return _column("v", path)


def _kind(path: str) -> str:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, ARRAY<..>, OBJECT<..>; NULL for an absent path."""
    return _column("k", path)


def _with_fields(parsed: DataFrame) -> DataFrame:
    """Every path of ``content`` taken out once, as a value and as the name of its type."""
    valued = parsed.selectExpr("*", *[f"try_variant_get(content, '$.{p}', 'variant') AS {_value(p)}" for p in PATHS])
    return valued.selectExpr("*", *[f"schema_of_variant({_value(p)}) AS {_kind(p)}" for p in PATHS])


# The rules are SQL text over those columns: one expression to parse instead of hundreds of calls.
# Every rule yields its message or NULL.


def _quoted(text: str) -> str:
    return '"' + text + '"'


def _is_number(path: str) -> str:
    kind = _kind(path)
    return f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT', 'BOOLEAN') OR startswith({kind}, 'DECIMAL'))"


def _type_name(path: str) -> str:
    """The type as the messages name it."""
    kind = _kind(path)
    return (
        f"""concat("<class '", CASE WHEN {kind} = 'STRING' THEN 'str' WHEN {kind} = 'BOOLEAN' THEN 'bool' """
        f"""WHEN {kind} = 'BIGINT' THEN 'int' WHEN startswith({kind}, 'ARRAY') THEN 'list' """
        f"""WHEN startswith({kind}, 'OBJECT') THEN 'dict' WHEN {kind} = 'VOID' THEN 'NoneType' ELSE 'float' END, "'>")"""
    )


def _number_text(path: str) -> str:
    text = f"CAST({_value(path)} AS STRING)"
    return f"CASE WHEN startswith({_kind(path)}, 'DECIMAL') AND NOT contains({text}, '.') THEN concat({text}, '.0') ELSE {text} END"


def _value_text(path: str) -> str:
    value, kind = _value(path), _kind(path)
    return (
        f"CASE WHEN {kind} = 'VOID' THEN 'None' WHEN {kind} = 'BOOLEAN' THEN initcap(CAST({value} AS STRING)) "
        f"WHEN {kind} = 'STRING' THEN try_variant_get({value}, '$', 'string') ELSE to_json({value}) END"
    )


def _absent(path: str, message: str, inside: str | None = None) -> str:
    nested = f"startswith({_kind(inside)}, 'OBJECT') AND " if inside else ""
    return f"CASE WHEN {nested}{_kind(path)} IS NULL THEN {_quoted(message)} END"


def _number_rule(label: str, path: str, bounds: tuple[int, int], name_type: bool, null_is_number: bool) -> str:
    low, high = bounds
    number = f"({_is_number(path)} OR {_kind(path)} = 'VOID')" if null_is_number else _is_number(path)
    wrong = f"concat({_quoted(label + ' must be numeric, got: ')}, {_type_name(path)})" if name_type else _quoted(label + " must be numeric")
    return (
        f"CASE WHEN NOT {number} THEN {wrong} "
        f"WHEN {_kind(path)} <> 'BOOLEAN' AND try_variant_get({_value(path)}, '$', 'double') NOT BETWEEN {low} AND {high} "
        f"THEN concat({_quoted(f'{label} out of range [{low}, {high}]: ')}, {_number_text(path)}) END"
    )


def _type_rule(path: str, prefix: str, what: str, name_type: bool = True) -> str:
    wrong = f"concat({_quoted(f'{path} must be a {what}, got: ')}, {_type_name(path)})" if name_type else _quoted(f"{path} must be a {what}")
    return f"WHEN NOT startswith({_kind(path)}, '{prefix}') THEN {wrong}"


def _domain_rule(field: str) -> str:
    """An absent field is another rule's matter: its kind is NULL, so this rule is silent."""
    path = f"market_impact.{field}"
    allowed = ", ".join(f"'{value}'" for value in K.IMPACT_DOMAIN)
    text = _quoted(f"{path} must be one of {list(K.IMPACT_DOMAIN)}, got: ")
    return (
        f"CASE WHEN NOT ({_kind(path)} = 'STRING' AND try_variant_get({_value(path)}, '$', 'string') IN ({allowed})) "
        f"THEN concat({text}, {_value_text(path)}) END"
    )


def _rules(profile: str, null_is_number: bool) -> list[str]:
    """All rules in message order; ``reduced`` leaves out those on sentences, summary and absent market fields."""
    full = profile == "full"
    rules = [
        _number_rule("hawkish_dovish_score", "hawkish_dovish_score", K.SCORE_RANGE, True, null_is_number),
        f"CASE {_type_rule('topics', 'OBJECT', 'dictionary')} END",
    ]
    for field in K.TOPIC_FIELDS:
        path = f"topics.{field}"
        rules.append(_absent(path, f"Missing topic field: {field}", inside="topics"))
        rules.append(_number_rule(f"Topic '{field}'", path, K.LEVEL_RANGE, full, null_is_number))
    for field in ("uncertainty", "forward_guidance_strength"):
        rules.append(_number_rule(field, field, K.LEVEL_RANGE, full, null_is_number))
    if full:
        entries = f"size(try_variant_get({_value('key_sentences')}, '$', 'array<variant>'))"
        rules.append(f"CASE {_type_rule('key_sentences', 'ARRAY', 'list')} WHEN {entries} = 0 THEN 'key_sentences is empty' END")
    rules.append(f"CASE {_type_rule('market_impact', 'OBJECT', 'dictionary', full)} END")
    if full:
        rules += [_absent(f"market_impact.{f}", f"Missing market_impact field: {f}", inside="market_impact") for f in K.MARKET_FIELDS]
    rules += [_domain_rule(field) for field in K.IMPACT_FIELDS]
    if full:
        text = f"try_variant_get({_value('summary')}, '$', 'string')"
        rules.append(f"CASE {_type_rule('summary', 'STRING', 'string')} WHEN NOT rlike({text}, r'(?U)\\S') THEN 'summary is empty' END")
    return rules


def validate(parsed: DataFrame, profile: str = "full", null_is_number: bool = False) -> DataFrame:
    """Add ``errors`` (messages in rule order) and ``is_valid`` to rows holding the VARIANT ``content``.

    Absent top-level fields hide all other errors. ``null_is_number`` lets NULL scores pass, as a NaN
    read from a table would.
    """
    return _checked(parsed.columns, _with_fields(parsed), profile, null_is_number)


def validate_flat(flat: DataFrame, profile: str = "full", null_is_number: bool = False) -> DataFrame:
    """The same rules on flat columns: every field is there, a NULL stands for a missing value.

    The columns' types are known, so no record is rebuilt and taken apart again.
    """
    names = {f"topics.{field}": f"topic_{field}" for field in K.TOPIC_FIELDS}
    names |= {f"market_impact.{field}": f"market_impact_{field}" for field in K.MARKET_FIELDS}
    scalars = {path: names.get(path, path) for path in PATHS if path not in ("topics", "market_impact", "key_sentences")}
    numbers = {"hawkish_dovish_score", "uncertainty", "forward_guidance_strength", *(f"topics.{f}" for f in K.TOPIC_FIELDS)}
    columns = {_kind("topics"): "'OBJECT<>'", _kind("market_impact"): "'OBJECT<>'", _kind("key_sentences"): "'ARRAY<STRING>'"}
    sentences = "CASE WHEN key_sentences IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array(key_sentences) END"
    columns[_value("key_sentences")] = f"CAST({sentences} AS VARIANT)"
    for path, name in scalars.items():
        kind = "DOUBLE" if path in numbers else "STRING"
        columns[_kind(path)] = f"CASE WHEN {name} IS NULL THEN 'VOID' ELSE '{kind}' END"
        columns[_value(path)] = f"CAST(CAST({name} AS {kind}) AS VARIANT)"
    fields = flat.selectExpr("*", *[f"{expression} AS {name}" for name, expression in columns.items()])
    return _checked(flat.columns, fields, profile, null_is_number)


def _checked(kept: Sequence[str], fields: DataFrame, profile: str, null_is_number: bool) -> DataFrame:
    missing = ", ".join(_absent(field, f"Missing required field: {field}") for field in K.TOP_FIELDS)
    any_missing = " OR ".join(f"{_kind(field)} IS NULL" for field in K.TOP_FIELDS)
    rules = ", ".join(_rules(profile, null_is_number))
    found = F.expr(f"array_compact(CASE WHEN {any_missing} THEN array({missing}) ELSE array({rules}) END)")
    checked = with_columns_once(fields, {"errors": found})
    return checked.select(*kept, "errors", (F.size("errors") == 0).alias("is_valid"))


def batch_summary(validated: DataFrame) -> DataFrame:
    """Total, valid, invalid, rate in percent (0 for no rows) and the quality tier."""
    valid = F.count_if(F.col("is_valid"))
    total = F.count(F.lit(1))
    rate = F.when(F.col("total") > 0, F.col("valid") / F.col("total") * 100).otherwise(F.lit(0.0))
    return (
        validated.agg(total.alias("total"), valid.alias("valid"))
        .withColumn("invalid", F.col("total") - F.col("valid"))
        .withColumn("validation_rate", rate)
        .withColumn("tier", quality_tier(F.col("validation_rate")))
    )


def error_histogram(validated: DataFrame) -> DataFrame:
    """Messages counted by the text before their first colon, most frequent first."""
    kinds = validated.select(F.explode("errors").alias("error")).select(F.substring_index("error", ":", 1).alias("error_type"))
    return kinds.groupBy("error_type").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "error_type")


def invalid_sample(validated: DataFrame, order_by: Sequence[str], key: str = "custom_id", rows: int = 5, errors: int = 3) -> DataFrame:
    """First ``rows`` invalid records and their first ``errors`` messages.

    An id that comes again keeps its first place and shows its last errors. A NULL place comes first. One order column
    is reduced by a hash aggregate of ids and places; messages are taken from the few chosen ids' rows only.
    """
    place = F.struct(*order_by)
    invalid = validated.where(~F.col("is_valid"))
    if len(order_by) == 1:
        first = F.when(~F.bool_or(F.col(order_by[0]).isNull()), F.min(order_by[0]))
    else:
        first = F.min(place)
    chosen = invalid.groupBy(F.col(key).alias("_k")).agg(first.alias("_first")).orderBy("_first").limit(rows)
    found = invalid.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_k")))
    last = found.groupBy(key).agg(F.max_by("errors", place).alias("errors"), F.min("_first").alias("_first"))
    return last.orderBy("_first").select(key, F.slice("errors", 1, errors).alias("errors"))
