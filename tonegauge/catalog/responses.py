"""Response parsing and validation (D, E)."""

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query, rounded
from tonegauge.plans import jobs
from tonegauge.operators import parse, validate

# DuckDB's JSON functions read the same lines
_ENVELOPE = "CASE WHEN json_valid(raw) THEN json_extract_string(raw, '{}') END"
CLASSIFIED = f"""{B.RESPONSES}, opened AS (SELECT *, {_ENVELOPE.format('$.custom_id')} AS custom_id,
  TRY_CAST({_ENVELOPE.format('$.response.status_code')} AS INT) AS status_code,
  {_ENVELOPE.format('$.response.body.choices[0].message.content')} AS c FROM responses),
classified AS (SELECT *, CASE WHEN custom_id IS NULL THEN 'malformed envelope'
  WHEN status_code <> 200 THEN concat('request failed: ', CAST(status_code AS VARCHAR))
  WHEN c IS NULL OR NOT json_valid(c) THEN 'content is not a JSON object' END AS reason FROM opened),
good AS (SELECT * FROM classified WHERE reason IS NULL)"""


def _text(path: str) -> str:
    return f"json_extract_string(c, '$.{path}')"


def _kind(path: str) -> str:
    return f"json_type(c, '$.{path}')"


def _number(path: str) -> str:
    return f"CASE {_kind(path)} WHEN 'VARCHAR' THEN NULL WHEN 'BOOLEAN' THEN CASE WHEN {_text(path)} = 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST({_text(path)} AS DOUBLE) END"


_FLAT = ", ".join([
    "custom_id AS speech_id",
    *[f"CAST({_number(path[2:])} AS DOUBLE) AS {name}" for name, path in parse._DOUBLE_PATHS.items()],
    *[f"{_text(path[2:])} AS {name}" for name, path in parse._STRING_PATHS.items()],
    f"coalesce({_text('market_impact.reasoning')}, {_text('reasoning')}) AS market_impact_reasoning",
    f"{_text('summary')} AS summary",
    "coalesce(array_to_string(json_extract_string(c, '$.key_sentences[*]'), '|'), '') AS key_sentences",
])
_FLAT_COLUMNS = ["speech_id", *parse._DOUBLE_PATHS, *parse._STRING_PATHS, "market_impact_reasoning", "summary", "key_sentences"]


def _classified(spark, sf, profile="full"):
    return parse.classify_responses(B.responses(spark, sf), profile=profile)


@query("d1_lenient_parse", f"WITH {CLASSIFIED} SELECT {_FLAT} FROM good")
def d1(spark, sf):
    return parse.parse_responses(B.responses(spark, sf)).select(*_FLAT_COLUMNS)


_COMPLETE = " AND ".join(f"{_kind(path[2:])} IS NOT NULL" for path in parse.REQUIRED_PATHS.values())


@query("d2_strict_parse", f"WITH {CLASSIFIED} SELECT {_FLAT} FROM good WHERE {_COMPLETE}")
def d2(spark, sf):
    return parse.parse_responses(B.responses(spark, sf), profile="reduced").select(*_FLAT_COLUMNS)


@query("d3_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def d3(spark, sf):
    value = F.try_parse_json("props")
    return B.table(spark, sf, "events").select(
        "event_id", F.try_variant_get(value, "$.k", "double").alias("k"), F.try_variant_get(value, "$.missing", "string").alias("missing")
    )


@query("d4_array_join_split", f"""WITH {CLASSIFIED}
SELECT custom_id AS speech_id, coalesce(array_to_string(json_extract_string(c, '$.key_sentences[*]'), '|'), '') AS joined,
  CAST(greatest(1, json_array_length(c, '$.key_sentences')) AS BIGINT) AS parts FROM good""")
def d4(spark, sf):
    flat = parse.parse_responses(B.responses(spark, sf))
    parts = F.size(parse.split_sentences(F.col("key_sentences"))).cast("bigint")
    return flat.select("speech_id", F.col("key_sentences").alias("joined"), parts.alias("parts"))


@query("d5_parse_quarantine", f"WITH {CLASSIFIED} SELECT md5(raw) AS raw_md5, custom_id, reason FROM classified WHERE reason IS NOT NULL")
def d5(spark, sf):
    aside = parse.quarantine(_classified(spark, sf))
    return aside.select(F.md5(F.col("raw").cast("binary")).alias("raw_md5"), "custom_id", "reason")


def _rules_sql(full: bool) -> list[str]:
    def number(label, path, low, high, typed):
        kind, names = _kind(path), "CASE {} WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' ELSE 'dict' END"
        wrong = f"concat('{label} must be numeric, got: <class ''', {names.format(kind)}, '''>')" if typed else f"'{label} must be numeric'"
        return (
            f"CASE WHEN {kind} IN ('VARCHAR', 'NULL', 'ARRAY', 'OBJECT') THEN {wrong} "
            f"WHEN TRY_CAST({_text(path)} AS DOUBLE) NOT BETWEEN {low} AND {high} AND {kind} <> 'BOOLEAN' "
            f"THEN concat('{label} out of range [{low}, {high}]: ', {_text(path)}) END"
        )

    topics_ok, market_ok = f"{_kind('topics')} = 'OBJECT'", f"{_kind('market_impact')} = 'OBJECT'"
    rules = [number("hawkish_dovish_score", "hawkish_dovish_score", *K.SCORE_RANGE, True),
             f"CASE WHEN NOT {topics_ok} THEN concat('topics must be a dictionary, got: <class ''', CASE {_kind('topics')} WHEN 'NULL' THEN 'NoneType' ELSE 'other' END, '''>') END"]
    for f in K.TOPIC_FIELDS:
        rules.append(f"CASE WHEN {topics_ok} AND {_kind('topics.' + f)} IS NULL THEN 'Missing topic field: {f}' END")
        rules.append(number(f"Topic ''{f}''", f"topics.{f}", *K.LEVEL_RANGE, full))
    rules += [number(f, f, *K.LEVEL_RANGE, full) for f in ("uncertainty", "forward_guidance_strength")]
    if full:
        rules.append("CASE WHEN json_array_length(c, '$.key_sentences') = 0 THEN 'key_sentences is empty' END")
        rules += [f"CASE WHEN {market_ok} AND {_kind('market_impact.' + f)} IS NULL THEN 'Missing market_impact field: {f}' END" for f in K.MARKET_FIELDS]
    for f in K.IMPACT_FIELDS:
        path = f"market_impact.{f}"
        rules.append(
            f"CASE WHEN {_kind(path)} IS NOT NULL AND coalesce({_text(path)}, '') NOT IN ('rise', 'fall', 'neutral') "
            f"THEN concat('market_impact.{f} must be one of [''rise'', ''fall'', ''neutral''], got: ', coalesce({_text(path)}, 'None')) END"
        )
    if full:
        rules.append(f"CASE WHEN trim({_text('summary')}) = '' THEN 'summary is empty' END")
    return rules


_MISSING = "nullif(concat_ws(' | ', " + ", ".join(f"CASE WHEN {_kind(f)} IS NULL THEN 'Missing required field: {f}' END" for f in K.TOP_FIELDS) + "), '')"


def _checked_sql(full: bool) -> str:
    return f"{CLASSIFIED}, checked AS (SELECT doc_id, custom_id, c, coalesce({_MISSING}, concat_ws(' | ', {', '.join(_rules_sql(full))})) AS errors FROM good)"


_FULL, _REDUCED = _checked_sql(True), _checked_sql(False)


def _validated(spark, sf, profile="full"):
    return validate.validate(parse.usable(_classified(spark, sf)), profile)


def _joined(df):
    return df.select("custom_id", F.array_join("errors", " | ").alias("errors"), "is_valid")


def _rule_query(name: str, prefix: str):
    """Rows that carry a message of one rule family."""
    condition = f"errors LIKE '%{prefix}%'"

    @query(name, f"WITH {_FULL} SELECT custom_id, errors FROM checked WHERE {condition}")
    def run(spark, sf):
        return _joined(_validated(spark, sf)).where(condition).drop("is_valid")

    return run


_rule_query("e1_required_fields", "Missing required field")
_rule_query("e2_numeric_type", "must be numeric")
_rule_query("e3_range", "out of range")
_rule_query("e4_nested_presence", "field: ")
_rule_query("e5_domain", "must be one of")
_rule_query("e6_non_empty", "is empty")


@query("e7_row_errors", f"WITH {_FULL} SELECT custom_id, errors, errors = '' AS is_valid FROM checked")
def e7(spark, sf):
    return _joined(_validated(spark, sf))


@query("e7_row_errors_reduced", f"WITH {_REDUCED} SELECT custom_id, errors, errors = '' AS is_valid FROM checked")
def e7_reduced(spark, sf):
    return _joined(_validated(spark, sf, "reduced"))


_PREPARED_BAD = "market_impact_bonds IS NULL OR market_impact_currency IS NULL OR market_impact_currency = 'strengthen' OR uncertainty IS NULL OR topic_international IS NULL"


@query("e7_flat_records", f"WITH {B.PREPARED} SELECT speech_id, NOT ({_PREPARED_BAD}) AS is_valid FROM prepared")
def e7_flat(spark, sf):
    return validate.validate_flat(B.prepared(spark, sf)).select("speech_id", "is_valid")


_RATE = "100.0 * valid / total"


@query("e8_batch_summary", f"""WITH {_FULL}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE errors = '') AS valid FROM checked)
SELECT total, valid, total - valid AS invalid, round({_RATE}, 6) AS validation_rate FROM s""")
def e8(spark, sf):
    return rounded(validate.batch_summary(_validated(spark, sf)), "validation_rate").drop("tier")


@query("e9_error_histogram", f"""WITH {_FULL}, e AS (SELECT unnest(string_split(errors, ' | ')) AS error FROM checked WHERE errors <> '')
SELECT split_part(error, ':', 1) AS error_type, count(*) AS occurrences FROM e GROUP BY 1""")
def e9(spark, sf):
    return validate.error_histogram(_validated(spark, sf))


@query("e10_invalid_sample", f"""WITH {_FULL} SELECT custom_id, array_to_string(string_split(errors, ' | ')[1:3], ' | ') AS errors
FROM checked WHERE errors <> '' ORDER BY doc_id LIMIT 5""")
def e10(spark, sf):
    sample = validate.invalid_sample(_validated(spark, sf), ["doc_id"])
    return sample.select("custom_id", F.array_join("errors", " | ").alias("errors"))


@query("e11_quality_tier", f"""WITH {_FULL}, s AS (SELECT doc_id % 23 AS class, count(*) AS total, count(*) FILTER (WHERE errors = '') AS valid FROM checked GROUP BY 1)
SELECT class, round({_RATE}, 6) AS rate, CASE WHEN {_RATE} >= 95 THEN 'excellent' WHEN {_RATE} >= 85 THEN 'good' ELSE 'low' END AS tier FROM s""")
def e11(spark, sf):
    from tonegauge.functions.scoring import quality_tier

    rates = _validated(spark, sf).groupBy((F.col("doc_id") % 23).alias("class")).agg(
        (F.count_if(F.col("is_valid")) / F.count("*") * 100).alias("rate")
    )
    return rounded(rates.withColumn("tier", quality_tier(F.col("rate"))), "rate")


@query("validation_report", f"""WITH {_FULL}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE errors = '') AS valid FROM checked),
k AS (SELECT split_part(unnest(string_split(errors, ' | ')), ':', 1) AS kind FROM checked WHERE errors <> ''),
h AS (SELECT kind, count(*) AS n FROM k GROUP BY kind), f AS (SELECT kind, n FROM h ORDER BY n DESC, kind LIMIT 1),
x AS (SELECT custom_id FROM checked WHERE errors <> '' GROUP BY custom_id ORDER BY custom_id LIMIT 5)
SELECT total, valid, total - valid AS invalid, round(valid * 100.0 / total, 6) AS validation_rate, (SELECT count(*) FROM h) AS kinds, (SELECT kind FROM f) AS first_kind,
  (SELECT n FROM f) AS first_count, (SELECT string_agg(custom_id, ',' ORDER BY custom_id) FROM x) AS sample FROM t""")
def validation_report(spark, sf):
    report = jobs.validation_report(B.responses(spark, sf).select("raw"))
    return report.select(
        "summary.total", "summary.valid", "summary.invalid", F.round("summary.validation_rate", 6).alias("validation_rate"), F.size("errors").cast("bigint").alias("kinds"),
        F.col("errors")[0]["error_type"].alias("first_kind"), F.col("errors")[0]["occurrences"].alias("first_count"),
        F.array_join(F.col("invalid_sample.custom_id"), ",").alias("sample"),
    )
