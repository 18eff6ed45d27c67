"""Texts, requests, packing and audit (C, E12, F3, G16, G20, H6, K)."""

import json
from string import Formatter

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query, rounded
from tonegauge.functions import scoring as S
from tonegauge.functions import text as X
from tonegauge.operators import audit, packing, requests
from tonegauge.plans import jobs
from tonegauge.session import scratch_path
from tonegauge.sources import writers
from tonegauge.operators.parse import classify_responses, flatten_content
from tonegauge.operators.scoring import envelope_lines, keyword_scorer, score_requests, score_with_function


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(t: str) -> str:
    n = lambda pattern: f"length(regexp_replace({t}, '{pattern}', '', 'g'))"
    return (
        f"(length({t}) + {n('[^\"' + chr(92) * 2 + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't' + chr(92) + 'x08' + chr(92) + 'x0c]')}"
        f" + 5 * {n(r'[^\x00-\x07\x0b\x0e-\x1f\x7f]')} + 5 * {n(r'[^\x{80}-\x{FFFF}]')} + 11 * {n(r'[^\x{10000}-\x{10FFFF}]')})"
    )


_SLOTS = {"text": "sent", "speaker": "coalesce(author, 'Unknown')", "institution": "coalesce(country, 'Unknown')", "date": "CAST(date AS VARCHAR)"}
_PIECES = list(Formatter().parse(requests.DEFAULT_TEMPLATE))
_PROMPT = "concat(" + ", ".join(
    part for literal, slot, _, _ in _PIECES for part in ([_quoted(literal)] if literal else []) + ([_SLOTS[slot]] if slot else [])
) + ")"
_SENT = f"CASE WHEN length(text) // 4 > 8000 THEN concat(substring(text, 1, 32000), {_quoted(K.TRUNCATION_NOTE)}) ELSE text END"
# whole texts; only c3 shows the cut
PROMPT_SQL = f"cut AS (SELECT *, text AS sent FROM speeches), prompts AS (SELECT *, {_PROMPT} AS prompt FROM cut)"
_FRAME = json.dumps({
    "custom_id": "", "method": K.REQUEST_METHOD, "url": K.REQUEST_URL,
    "body": {"model": K.MODEL_NAME, "messages": [{"role": "system", "content": K.SYSTEM_MESSAGE}, {"role": "user", "content": ""}],
             "response_format": {"type": K.RESPONSE_FORMAT}, "temperature": K.TEMPERATURE["full"]},
})
TOKENS_SQL = f"request_tokens AS (SELECT *, ({len(_FRAME)} + {_escaped_sql('speech_id')} + {_escaped_sql('prompt')}) // 4 AS tokens FROM prompts)"

# every test document holds some of these, unlike the audit's own lists, of which only a few occur
UP_TERMS, DOWN_TERMS = ("inflation", "the", "with", "on the", "est"), ("ease", "and", "weak", "that", "oun")


@query("c1_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def c1(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("c2_serialized_tokens", f"WITH {B.SPEECHES}, {PROMPT_SQL}, {TOKENS_SQL} SELECT speech_id AS custom_id, CAST(tokens AS BIGINT) AS tokens FROM request_tokens")
def c2(spark, sf):
    return requests.build_requests(B.speeches(spark, sf)).select("custom_id", "tokens")


@query("c3_limit_truncation", f"""WITH {B.SPEECHES}, cut AS (SELECT *, {_SENT} AS sent FROM speeches)
SELECT speech_id, CAST(length(sent) AS BIGINT) AS sent_length, md5(sent) AS sent_md5, sent <> text AS cut FROM cut""")
def c3(spark, sf):
    sent = B.speeches(spark, sf).withColumn("sent", X.clip_to_limit(F.col("text")))
    return sent.select(
        "speech_id", F.length("sent").cast("bigint").alias("sent_length"), F.md5(F.col("sent").cast("binary")).alias("sent_md5"),
        (F.col("sent") != F.col("text")).alias("cut"),
    )


@query("c4_display_truncation", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 97), '...') ELSE text END AS shown FROM documents")
def c4(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.shorten(F.col("text")).alias("shown"))


@query("c5_prompt_rendering", f"""WITH {B.SPEECHES}, {PROMPT_SQL}
SELECT speech_id AS custom_id, md5(prompt) AS prompt_md5, CAST(length(prompt) // 4 AS BIGINT) AS prompt_tokens FROM prompts""")
def c5(spark, sf):
    built = requests.build_requests(B.speeches(spark, sf))
    return built.select("custom_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "prompt_tokens")


@query("c6_request_construction", f"""WITH {B.SPEECHES}, {PROMPT_SQL}
SELECT speech_id AS custom_id, '{K.REQUEST_URL}' AS url, 'user' AS second_role, '{K.RESPONSE_FORMAT}' AS response_format,
  0.0::DOUBLE AS temperature, md5(replace(prompt, sent, text)) AS content_md5 FROM prompts""")
def c6(spark, sf):
    built = requests.build_requests(B.speeches(spark, sf), profile="reduced")
    return built.select(
        "custom_id", "request.url", F.col("request.body.messages")[1]["role"].alias("second_role"),
        F.col("request.body.response_format.type").alias("response_format"), "request.body.temperature",
        F.md5(F.col("request.body.messages")[1]["content"].cast("binary")).alias("content_md5"),
    )


_TRIMMED = r"regexp_replace(regexp_replace(sent, '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ''), '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$', '')"


@query("c7_section_extraction", f"""WITH {B.SPEECHES}, {PROMPT_SQL}
SELECT speech_id, md5({_TRIMMED}) AS section_md5 FROM cut""")
def c7(spark, sf):
    built = requests.build_requests(B.speeches(spark, sf)).select("request.*")
    return audit.request_texts(built).select("speech_id", F.md5(F.col("speech_text").cast("binary")).alias("section_md5"))


def _term_sql(terms, text="text"):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower({text}), '{t}') THEN '{t}' END" for t in terms) + ")"


def _count_sql(terms, text="text"):
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{t}') AS INT)" for t in terms) + ")"


@query("c8_keyword_match", f"""SELECT doc_id, {_term_sql(UP_TERMS)} AS up, {_term_sql(DOWN_TERMS)} AS down,
  {_term_sql(K.HAWKISH_TERMS)} AS hawkish, {_term_sql(K.DOVISH_TERMS)} AS dovish FROM documents""")
def c8(spark, sf):
    joined = lambda terms: F.array_join(X.matched_terms(F.col("text"), terms), ",")
    return B.table(spark, sf, "documents").select(
        "doc_id", joined(UP_TERMS).alias("up"), joined(DOWN_TERMS).alias("down"),
        joined(K.HAWKISH_TERMS).alias("hawkish"), joined(K.DOVISH_TERMS).alias("dovish"),
    )


def _verdict_sql(score, h, d):
    v = {key: _quoted(text) for key, text in K.VERDICTS.items()}
    return f"""CASE WHEN {score} > 20 THEN CASE WHEN {h} > {d} THEN {v['hawkish', True]} ELSE {v['hawkish', False]} END
WHEN {score} < -20 THEN CASE WHEN {d} > {h} THEN {v['dovish', True]} ELSE {v['dovish', False]} END
ELSE CASE WHEN abs({h} - {d}) <= 2 THEN {v['neutral', True]} ELSE {v['neutral', False]} END END"""


_SCORE = "CAST((doc_id * 31) % 201 - 100 AS DOUBLE)"


@query("c9_score_assessment", f"""WITH d AS (SELECT doc_id, {_SCORE} AS score, {_count_sql(UP_TERMS)} AS up, {_count_sql(DOWN_TERMS)} AS down FROM documents)
SELECT doc_id, score, up, down, {_verdict_sql('score', 'up', 'down')} AS assessment FROM d""")
def c9(spark, sf):
    counted = B.table(spark, sf, "documents").select(
        "doc_id", F.expr(_SCORE).alias("score"),
        F.size(X.matched_terms(F.col("text"), UP_TERMS)).alias("up"), F.size(X.matched_terms(F.col("text"), DOWN_TERMS)).alias("down"),
    )
    return counted.withColumn("assessment", X.score_verdict(F.col("score"), F.col("up"), F.col("down")))


@query("c9_full_audit", f"""WITH {B.SPEECHES}, scored AS (SELECT *, {_SCORE} AS score FROM speeches)
SELECT speech_id, score, {_count_sql(UP_TERMS)} AS up, {_count_sql(DOWN_TERMS)} AS down, {_verdict_sql('score', _count_sql(UP_TERMS), _count_sql(DOWN_TERMS))} AS assessment
FROM scored""")
def c9_audit(spark, sf):
    speeches = B.speeches(spark, sf)
    texts = speeches.select("speech_id", F.col("text").alias("speech_text"))
    scored = speeches.select("speech_id", F.expr(_SCORE).alias("score"))
    return audit.assess(scored, texts, "score", hawkish=UP_TERMS, dovish=DOWN_TERMS).select(
        "speech_id", "score", F.size("hawkish_terms").alias("up"), F.size("dovish_terms").alias("down"), "assessment"
    )


@query("c10_cost_per_thousand", """SELECT doc_id, round((length(text) // 4) / 1000.0 * 0.0025 + 500 / 1000.0 * 0.010, 9) AS realtime,
  round((length(text) // 4) / 1000.0 * 0.00125 + 500 / 1000.0 * 0.005, 9) AS batch FROM documents""")
def c10(spark, sf):
    tokens = X.token_estimate(F.col("text"))
    cost = lambda prices: F.round(S.cost_per_thousand(tokens, F.lit(500), prices), 9)
    return B.table(spark, sf, "documents").select("doc_id", cost(K.REALTIME_PER_1K).alias("realtime"), cost(K.BATCH_PER_1K).alias("batch"))


@query("c11_cost_per_million", "SELECT doc_id, round(((length(text) // 4) / 1e6 * 2.5 + 500 / 1e6 * 10) * 0.5, 9) AS cost FROM documents")
def c11(spark, sf):
    cost = S.cost_per_million(X.token_estimate(F.col("text")), F.lit(500))
    return B.table(spark, sf, "documents").select("doc_id", F.round(cost, 9).alias("cost"))


_AMOUNT = "CAST(doc_id AS DOUBLE) * 0.0003 + 0.00001"  # never half-way between two printed values


@query("c12_cost_format", f"""WITH c AS (SELECT doc_id, {_AMOUNT} AS cost FROM documents)
SELECT doc_id, CASE WHEN cost < 0.01 THEN printf('$%.4f¢', cost * 100) WHEN cost < 1 THEN printf('$%.4f', cost) ELSE printf('$%.2f', cost) END AS label FROM c""")
def c12(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", S.cost_label(F.expr(_AMOUNT)).alias("label"))


@query("c13_excerpt", "SELECT doc_id, concat(substring(text, 1, 500), '...') AS excerpt FROM documents")
def c13(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("g16_request_statistics", f"""WITH {B.SPEECHES}, {PROMPT_SQL}, s AS (SELECT count(*) AS n, CAST(sum(length(prompt) // 4) AS BIGINT) AS t FROM prompts)
SELECT n AS num_requests, t AS total_input_tokens, n * 500 AS estimated_output_tokens,
  round(t / 1000.0 * 0.00125 + n * 500 / 1000.0 * 0.005, 6) AS batch_cost_estimate, round(t / 1000.0 * 0.0025 + n * 500 / 1000.0 * 0.010, 6) AS realtime_cost_estimate,
  round((t / 1e6 * 2.5 + n * 500 / 1e6 * 10) * 0.5, 6) AS discounted_cost_estimate, round(t / 1000.0 * 0.00125 + n * 500 / 1000.0 * 0.005, 6) AS savings FROM s""")
def g16(spark, sf):
    stats = requests.request_statistics(requests.build_requests(B.speeches(spark, sf)))
    return rounded(stats, "batch_cost_estimate", "realtime_cost_estimate", "discounted_cost_estimate", "savings")


def _chunk_sql(rows: str, limit: int) -> str:
    """Greedy packing, one row after the other (``rows`` has n = 1, 2, ... and tokens)."""
    over = f"g.used + r.tokens > {limit}"
    return f"""packed AS (SELECT n, tokens, tokens AS used, CAST(1 AS BIGINT) AS chunk_id FROM {rows} WHERE n = 1
UNION ALL SELECT r.n, r.tokens, CASE WHEN {over} THEN r.tokens ELSE g.used + r.tokens END, CASE WHEN {over} THEN g.chunk_id + 1 ELSE g.chunk_id END
FROM packed g JOIN {rows} r ON r.n = g.n + 1)"""


@query("h6_token_chunks", f"""WITH RECURSIVE rows AS (SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
{_chunk_sql('rows', 2000)} SELECT doc_id, packed.tokens, chunk_id FROM packed JOIN rows USING (n)""")
def h6(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return packing.greedy_chunks(rows, ["doc_id"], max_tokens=2000)


_REQUEST_ROWS = f"{B.SPEECHES}, {PROMPT_SQL}, {TOKENS_SQL}, rows AS (SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, row_number() OVER (ORDER BY date, doc_id) AS n FROM request_tokens)"


def _packed_requests(spark, sf):
    built = requests.build_requests(B.speeches(spark, sf).withColumn("day", F.col("date")), keep=["day", "doc_id"])
    return packing.greedy_chunks(built.select("custom_id", "tokens", "day", "doc_id"), ["day", "doc_id"])


@query("g20_chunk_statistics", f"""WITH RECURSIVE {_REQUEST_ROWS}, {_chunk_sql('rows', K.CHUNK_TOKENS['full'])}
SELECT chunk_id, count(*) AS num_requests, CAST(sum(tokens) AS BIGINT) AS chunk_tokens FROM packed GROUP BY chunk_id""")
def g20(spark, sf):
    return packing.chunk_statistics(_packed_requests(spark, sf))


@query("c14_flat_estimates", f"""WITH RECURSIVE {_REQUEST_ROWS}, {_chunk_sql('rows', K.CHUNK_TOKENS['full'])}
SELECT max(chunk_id) AS num_chunks, count(*) AS num_requests, round(CAST(count(*) * 0.0075 AS DOUBLE), 6) AS estimated_cost,
  max(chunk_id) * 3 AS minutes_low, max(chunk_id) * 5 AS minutes_high FROM packed""")
def c14(spark, sf):
    totals = packing.chunk_totals(packing.chunk_statistics(_packed_requests(spark, sf)))
    return rounded(requests.flat_estimates(totals), "estimated_cost")


_REQUEST_LINE = """CASE doc_id % 11 WHEN 0 THEN concat('{"custom_id": "speech_', CAST(doc_id AS STRING))
WHEN 1 THEN concat('{"custom_id": "speech_', CAST(doc_id AS STRING), '", "method": "POST", "body": {}}')
ELSE concat('{"custom_id": "speech_', CAST(doc_id AS STRING), '", "method": "POST", "url": "/v1", "body": {"lang": "', lang, '"}}') END"""


@query("e12_request_file_validation", f"""WITH lines AS (SELECT doc_id, {_REQUEST_LINE} AS raw FROM documents)
SELECT doc_id, CASE WHEN NOT json_valid(raw) THEN 'Invalid JSON' ELSE 'Missing required field ''url''' END AS error FROM lines
WHERE NOT json_valid(raw) OR json_extract(raw, '$.url') IS NULL""")
def e12(spark, sf):
    lines = B.table(spark, sf, "documents").select("doc_id", F.expr(_REQUEST_LINE).alias("raw"))
    return requests.request_file_errors(lines).select("doc_id", "error")


@query("e12_line_context", f"""WITH lines AS (SELECT doc_id // 100000 AS part, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id) AS line_number, {_REQUEST_LINE} AS raw FROM documents)
SELECT part, line_number, CASE WHEN NOT json_valid(raw) THEN 'Invalid JSON' ELSE 'Missing required field ''url''' END AS error FROM lines
WHERE NOT json_valid(raw) OR json_extract(raw, '$.url') IS NULL""")
def e12_context(spark, sf):
    """Files of up to 100,000 request lines, read in splits of 16 kB."""
    path = scratch_path(spark, "request_files")
    lines = B.table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 100000").alias("part"), F.expr(_REQUEST_LINE).alias("raw"))
    lines.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "raw").write.partitionBy("part").text(path)
    found = requests.request_file_context(spark, path, size=1 << 14)
    return found.select(F.regexp_extract("file_name", r"part=(\d+)", 1).cast("bigint").alias("part"), "line_number", "error")


@query("k1_scored_requests", f"""WITH {B.SPEECHES}, {PROMPT_SQL}, s AS (SELECT speech_id,
  greatest(-100, least(100, 20 * ({_count_sql(UP_TERMS, 'sent')} - {_count_sql(DOWN_TERMS, 'sent')}))) AS score,
  {_count_sql(UP_TERMS, 'sent')} AS up, {_count_sql(DOWN_TERMS, 'sent')} AS down FROM cut)
SELECT speech_id, CAST(score AS DOUBLE) AS hawkish_dovish_score, CAST(least(100, 10 * (up + down)) AS DOUBLE) AS topic_growth,
  CASE WHEN score = 0 THEN 'neutral' WHEN score > 0 THEN 'rise' ELSE 'fall' END AS market_impact_stocks,
  concat('Keyword balance ', CAST(up - down AS VARCHAR)) AS summary FROM s""")
def k1(spark, sf):
    built = requests.build_requests(B.speeches(spark, sf))
    lines = envelope_lines(score_requests(built, keyword_scorer(UP_TERMS, DOWN_TERMS)))
    flat = flatten_content(classify_responses(lines))
    return flat.select("speech_id", "hawkish_dovish_score", "topic_growth", "market_impact_stocks", "summary")


@query("k1_user_function", f"WITH {B.SPEECHES}, {PROMPT_SQL} SELECT speech_id, CAST(length(prompt) % 101 AS DOUBLE) AS hawkish_dovish_score FROM prompts")
def k1_user(spark, sf):
    def lengths(prompts):
        return prompts.str.len().map(lambda n: f'{{"hawkish_dovish_score": {n % 101}}}')

    lines = envelope_lines(score_with_function(requests.build_requests(B.speeches(spark, sf)), lengths))
    return flatten_content(classify_responses(lines)).select("speech_id", "hawkish_dovish_score")


_PACKED_LINES = f"""WITH RECURSIVE rows AS (SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
{_chunk_sql('rows', 20_000)} SELECT concat('chunk', CASE WHEN chunk_id < 10 THEN '0' ELSE '' END, CAST(chunk_id AS VARCHAR), '_input') AS chunk_file, count(*) AS lines FROM packed GROUP BY chunk_id"""


def _packed_documents(spark, sf):
    docs = B.table(spark, sf, "documents")
    rows = docs.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return docs.select("doc_id", "text").join(packing.greedy_chunks(rows, ["doc_id"], max_tokens=20_000).select("doc_id", "chunk_id"), "doc_id")


@query("a8_packed_folders", _PACKED_LINES)
def a8_folders(spark, sf):
    path = scratch_path(spark, "sink")
    lines = _packed_documents(spark, sf).withColumn("line", F.to_json(F.struct("doc_id", "text")))
    writers.write_chunks(lines, path, "line", order=["doc_id"])
    return spark.read.schema("value STRING, chunk_file STRING").text(path).groupBy("chunk_file").agg(F.count("*").alias("lines"))


@query("a8_packed_table", _PACKED_LINES)
def a8_table(spark, sf):
    path = scratch_path(spark, "sink")
    writers.write_chunk_table(_packed_documents(spark, sf), path, "text", order=["doc_id"])
    return spark.read.parquet(path).groupBy("chunk_file").agg(F.count("*").alias("lines"))


@query("score_audit", f"""WITH {B.SPEECHES}, s AS (SELECT speech_id, date, country, text, CAST({_SCORE} AS DOUBLE) AS score FROM speeches),
p AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date, speech_id) - 1 AS place, count(*) OVER (PARTITION BY country) AS n, max(score) OVER (PARTITION BY country) AS hi, min(score) OVER (PARTITION BY country) AS lo FROM s),
e AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date, speech_id) AS pick FROM p WHERE score = CASE WHEN abs(hi) > abs(lo) THEN hi ELSE lo END),
m AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(concat('42:', speech_id)), speech_id) AS pick FROM p WHERE place >= floor(n * 0.2) AND place < floor(n * 0.8)),
u AS (SELECT 'extreme' AS sample, country, speech_id, score, text FROM e WHERE pick = 1 UNION ALL SELECT 'middle', country, speech_id, score, text FROM m WHERE pick = 1)
SELECT sample, country, speech_id, score, {_count_sql(UP_TERMS)} AS up, {_count_sql(DOWN_TERMS)} AS down, {_verdict_sql('score', _count_sql(UP_TERMS), _count_sql(DOWN_TERMS))} AS assessment FROM u""")
def score_audit(spark, sf):
    speeches = B.speeches(spark, sf)
    scored = speeches.select("speech_id", "date", "country", F.expr(_SCORE).cast("double").alias("hawkish_dovish_score"))
    texts = speeches.select("speech_id", F.col("text").alias("speech_text"))
    found = jobs.score_audit(scored, texts, hawkish=UP_TERMS, dovish=DOWN_TERMS)
    return found.select("sample", "country", "speech_id", F.col("hawkish_dovish_score").alias("score"), F.size("hawkish_terms").alias("up"), F.size("dovish_terms").alias("down"), "assessment")
