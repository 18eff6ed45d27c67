"""Filters, derivations, joins, order and set operations (B, F, I, J)."""

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query, rounded
from tonegauge.functions.scoring import number_in, polarity, result_name, stance
from tonegauge.operators import audit, contracts, ingest, joins
from tonegauge.operators.calendar import long_index
from tonegauge.operators.indices import daily_indices
from tonegauge.operators.ledger import latest_states
from tonegauge.operators.positions import add_positions, sequential_ids
from tonegauge.operators.profile import invalid_dates
from tonegauge.session import scratch_path
from tonegauge.sources.bucketed import latest_of, write_bucketed


@query("b1_year_sample", f"""WITH {B.PREPARED}
SELECT speech_id, date, country, CAST(year(date) AS INT) AS year FROM prepared
WHERE year(date) BETWEEN 1996 AND 1998 AND country = '1-URGENT'""")
def b1(spark, sf):
    kept = ingest.sample_years(B.prepared(spark, sf), 1996, 1998, "1-URGENT", "country")
    return kept.select("speech_id", "date", "country", "year")


@query("b2_date_range", """SELECT event_type, count(*) AS n,
  count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20') AS n_midnight FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY event_type""")
def b2(spark, sf):
    events = B.table(spark, sf, "events").withColumnRenamed("ts", "date")
    whole = ingest.between_dates(events, "2024-01-05", "2024-01-20")
    until_midnight = F.col("date") <= F.lit("2024-01-20").cast("date")
    return whole.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(until_midnight).alias("n_midnight"))


@query("b3_institution_filter", f"WITH {B.PREPARED} SELECT speech_id, country FROM prepared WHERE country = '2-HIGH'")
def b3(spark, sf):
    return ingest.only_institution(B.prepared(spark, sf), "2-HIGH").select("speech_id", "country")


@query("b4_column_resolution", "SELECT doc_id, 'text' AS chosen, CAST(length(text) AS BIGINT) AS characters FROM documents")
def b4(spark, sf):
    documents = B.table(spark, sf, "documents")
    name = contracts.resolve_column(documents, ("clean_text", "text"))
    return documents.select("doc_id", F.lit(name).alias("chosen"), F.length(name).cast("bigint").alias("characters"))


@query("b5_default_fill", f"""WITH {B.SPEECHES}
SELECT speech_id, coalesce(author, 'Unknown') AS author, 'Unknown' AS venue FROM speeches""")
def b5(spark, sf):
    return contracts.fill_defaults(B.speeches(spark, sf), ["author", "venue"]).select("speech_id", "author", "venue")


@query("b6_sequential_id", f"""WITH {B.PREPARED}
SELECT order_key, concat('speech_', CAST(row_number() OVER (ORDER BY date, order_key) - 1 AS VARCHAR)) AS new_id FROM prepared""")
def b6(spark, sf):
    frame = B.prepared(spark, sf).select("order_key", "date")
    return sequential_ids(frame, ["date", "order_key"], name="new_id").select("order_key", "new_id")


@query("b7_id_parsing", f"""WITH {B.LEDGER}
SELECT event_id, chunk_number, CAST(regexp_extract(chunk_name, 'chunk(\\d+)_input', 1) AS BIGINT) AS from_name,
  TRY_CAST(nullif(regexp_extract(CASE WHEN event_id % 9 = 0 THEN 'speech_x' ELSE concat('speech_', CAST(event_id AS VARCHAR)) END, 'speech_(\\d+)', 1), '') AS BIGINT) AS row_index,
  replace(chunk_name, '_input', '_results') AS result_file FROM ledger""")
def b7(spark, sf):
    spoken = F.when(F.col("event_id") % 9 == 0, F.lit("speech_x")).otherwise(ingest.speech_id(F.col("event_id")))
    return B.ledger(spark, sf).select(
        "event_id", "chunk_number", number_in(F.col("chunk_name"), "chunk", "_input").alias("from_name"),
        number_in(spoken, "speech_").alias("row_index"), result_name(F.col("chunk_name")).alias("result_file"),
    )


# some dates arrive with a thirteenth month
_RAW_DATE = "CASE WHEN order_key % 50 = 0 THEN '1996-13-01' ELSE CAST(date AS STRING) END AS date"
_RAW = f"raw AS (SELECT order_key, {_RAW_DATE} FROM prepared)"


def _raw_dates(spark, sf):
    return B.prepared(spark, sf).selectExpr("order_key", _RAW_DATE)


@query("b8_date_coercion", f"WITH {B.PREPARED}, {_RAW} SELECT order_key, TRY_CAST(date AS DATE) AS date FROM raw WHERE TRY_CAST(date AS DATE) IS NOT NULL")
def b8(spark, sf):
    return ingest.split_by_date(_raw_dates(spark, sf))[0]


@query("b8_dates_set_aside", f"""WITH {B.PREPARED}, {_RAW}
SELECT count(*) AS rows, count(*) FILTER (WHERE TRY_CAST(date AS DATE) IS NULL) AS invalid_dates FROM raw""")
def b8_aside(spark, sf):
    return invalid_dates(ingest.coerce_dates(_raw_dates(spark, sf)))


@query("b9_projection", f"""WITH {B.PREPARED}
SELECT date, speech_id, market_impact_stocks AS stocks, market_impact_bonds AS bonds FROM prepared""")
def b9(spark, sf):
    picked = B.prepared(spark, sf).select("date", "speech_id", "market_impact_stocks", "market_impact_bonds")
    return contracts.rename(picked, {"market_impact_stocks": "stocks", "market_impact_bonds": "bonds"})


@query("b10_stance_bucket", f"""WITH {B.PREPARED}
SELECT country, CASE WHEN hawkish_dovish_score < -50 THEN 'very_dovish' WHEN hawkish_dovish_score < -10 THEN 'dovish'
  WHEN hawkish_dovish_score <= 10 THEN 'neutral' WHEN hawkish_dovish_score <= 50 THEN 'hawkish' ELSE 'very_hawkish' END AS stance, count(*) AS n
FROM prepared GROUP BY 1, 2""")
def b10(spark, sf):
    return B.prepared(spark, sf).groupBy("country", stance(F.col("hawkish_dovish_score")).alias("stance")).agg(F.count("*").alias("n"))


@query("b11_polarity", f"""WITH {B.PREPARED}
SELECT speech_id, CASE WHEN hawkish_dovish_score > 0 THEN 'positive' ELSE 'negative' END AS side,
  CASE WHEN hawkish_dovish_score >= 0 THEN 'positive' ELSE 'negative' END AS side_ties_up,
  forward_guidance_strength - 50 AS from_neutral FROM prepared""")
def b11(spark, sf):
    score = F.col("hawkish_dovish_score")
    return B.prepared(spark, sf).select(
        "speech_id", polarity(score, F.lit(0)).alias("side"), polarity(score, F.lit(0), "positive").alias("side_ties_up"),
        (F.col("forward_guidance_strength") - 50).alias("from_neutral"),
    )


@query("b12_metric_catalog", f"""WITH {B.PREPARED}, daily AS (SELECT country, date, avg(hawkish_dovish_score) AS h, avg(topic_growth) AS g, CAST(count(*) AS DOUBLE) AS n
  FROM prepared GROUP BY country, date)
SELECT country, date, 'hawkish_dovish_score' AS metric, round(h, 6) AS value, 'policy' AS family, 0.0::DOUBLE AS neutral,
  'Hawkish/Dovish Score (0=neutral, +100=hawkish, -100=dovish)' AS title FROM daily
UNION ALL SELECT country, date, 'topic_growth', round(g, 6), 'topic', NULL, 'Growth (0-100, higher=more emphasis)' FROM daily
UNION ALL SELECT country, date, 'speech_count', n, 'policy', NULL, 'Speech Count' FROM daily""")
def b12(spark, sf):
    daily = daily_indices(B.prepared(spark, sf), means=["hawkish_dovish_score", "topic_growth"], impacts=[])
    return rounded(long_index(daily), "value").select(
        "country", "date", "metric", "value", "family", "neutral", F.col("title_with_scale").alias("title")
    )


_FAMILY = {entry[0]: entry[1] for entry in K.METRIC_CATALOG}["speech_count"]


@query("b12_unknown_metric", f"""WITH d AS (SELECT event_type AS country, CAST(ts AS DATE) AS date, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)
SELECT country, date, 'value' AS metric, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS family FROM d
UNION ALL SELECT country, date, 'speech_count', CAST(n AS DOUBLE), '{_FAMILY}' FROM d""")
def b12_unknown(spark, sf):
    events = B.table(spark, sf, "events").select(F.col("event_type").alias("country"), F.col("ts").cast("date").alias("date"), "value")
    daily = daily_indices(events, means=["value"], impacts=[])
    return rounded(long_index(daily), "value").select("country", "date", "metric", "value", "family")


def _scored_documents(spark, sf):
    scored = B.table(spark, sf, "labels")
    return scored.select(ingest.speech_id(F.col("doc_id")).alias("speech_id"), "quality", "toxic")


@query("f1_positional_join", f"""WITH {B.SPEECHES}, placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM speeches)
SELECT date, author, country, title, concat('speech_', CAST(l.doc_id AS VARCHAR)) AS speech_id, quality, toxic
FROM placed p JOIN labels l ON l.doc_id = p.row_index""")
def f1(spark, sf):
    return joins.join_by_position(B.speeches(spark, sf), _scored_documents(spark, sf), ["doc_id"])


@query("f2_key_join", f"""WITH {B.SPEECHES}
SELECT s.speech_id, date, author, country, title, quality, toxic
FROM speeches s JOIN labels l ON s.speech_id = concat('speech_', CAST(l.doc_id AS VARCHAR))""")
def f2(spark, sf):
    columns = B.speeches(spark, sf).select("speech_id", "date", "author", "country", "title")
    return joins.join_by_key(columns, _scored_documents(spark, sf))


@query("f3_lookup_join", f"""WITH {B.SPEECHES}
SELECT concat('speech_', CAST(l.doc_id * 2 AS VARCHAR)) AS speech_id, quality, title, s.speech_id IS NOT NULL AS found
FROM labels l LEFT JOIN speeches s ON s.speech_id = concat('speech_', CAST(l.doc_id * 2 AS VARCHAR))""")
def f3(spark, sf):
    sample = B.table(spark, sf, "labels").select(ingest.speech_id(F.col("doc_id") * 2).alias("speech_id"), "quality")
    return joins.lookup(sample, B.speeches(spark, sf).select("speech_id", "title"), "speech_id")


_CHUNK_FILES = "chunk_files AS (SELECT DISTINCT concat('chunk', CAST(c_custkey AS VARCHAR), '_input.jsonl') AS chunk_name FROM customer)"


def _chunk_files(spark, sf):
    key = F.concat(F.lit("chunk"), F.col("c_custkey").cast("string"), F.lit("_input.jsonl"))
    return B.table(spark, sf, "customer").select(key.alias("chunk_name")).distinct()


@query("f4_ledger_anti_join", f"""WITH {B.LEDGER}, {_CHUNK_FILES}
SELECT chunk_name FROM chunk_files WHERE chunk_name NOT IN (SELECT chunk_name FROM ledger)""")
def f4(spark, sf):
    return joins.untracked_chunks(_chunk_files(spark, sf), B.ledger(spark, sf))


@query("f4_chunks_to_submit", f"""WITH {B.LEDGER}, {_CHUNK_FILES}, latest AS (SELECT chunk_name, arg_max(status, struct_pack(a := updated_at, b := event_id)) AS status FROM ledger GROUP BY 1)
SELECT chunk_name FROM chunk_files WHERE chunk_name NOT IN (SELECT chunk_name FROM latest WHERE status IN ('completed', 'in_progress'))""")
def f4_submit(spark, sf):
    latest = latest_states(B.ledger(spark, sf), order_by=["updated_at", "event_id"])
    return joins.chunks_to_submit(_chunk_files(spark, sf), latest, ["completed", "in_progress"])


@query("i1_chronological_sort", f"""WITH {B.PREPARED}, s AS (SELECT speech_id, date, row_number() OVER (ORDER BY date, speech_id) AS n FROM prepared)
SELECT speech_id, date FROM s""")
def i1(spark, sf):
    return ingest.by_time(B.prepared(spark, sf).select("speech_id", "date"))


@query("i2_id_sort", f"WITH {B.SPEECHES} SELECT speech_id, row_number() OVER (ORDER BY speech_id) - 1 AS place FROM speeches")
def i2(spark, sf):
    # the place in the sorted result shows the order, which a set of rows would not
    return add_positions(B.speeches(spark, sf).select("speech_id"), ["speech_id"], name="place")


@query("i4_extreme_pick", f"""WITH {B.PREPARED}, a AS (SELECT country, max(hawkish_dovish_score) AS hi, min(hawkish_dovish_score) AS lo FROM prepared GROUP BY country),
  r AS (SELECT p.country, p.speech_id, p.date, p.hawkish_dovish_score,
    row_number() OVER (PARTITION BY p.country ORDER BY p.date, p.speech_id) AS n
  FROM prepared p JOIN a ON a.country = p.country AND p.hawkish_dovish_score = CASE WHEN abs(hi) > abs(lo) THEN hi ELSE lo END)
SELECT country, speech_id, date, hawkish_dovish_score FROM r WHERE n = 1""")
def i4(spark, sf):
    return audit.extreme_rows(B.prepared(spark, sf))


@query("i5_middle_sample", f"""WITH {B.PREPARED}, p AS (SELECT country, speech_id, date, hawkish_dovish_score,
    row_number() OVER (PARTITION BY country ORDER BY date, speech_id) - 1 AS place, count(*) OVER (PARTITION BY country) AS n FROM prepared),
  m AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(concat('42:', speech_id)), speech_id) AS pick FROM p
    WHERE place >= floor(n * 0.2) AND place < floor(n * 0.8))
SELECT country, speech_id, date, hawkish_dovish_score FROM m WHERE pick = 1""")
def i5(spark, sf):
    return audit.middle_rows(B.prepared(spark, sf))


@query("i6_head", f"""WITH {B.PREPARED}
SELECT date, author, country, hawkish_dovish_score FROM prepared ORDER BY date, speech_id LIMIT 5""")
def i6(spark, sf):
    columns = ["date", "author", "country", "hawkish_dovish_score"]
    return ingest.head(B.prepared(spark, sf), ["date", "speech_id"], columns)


@query("j1_union_chunks", "SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src3'")
def j1(spark, sf):
    documents = B.table(spark, sf, "documents").select("doc_id", "source")
    again = documents.where(F.col("source") == "src3")
    return ingest.union_chunks([documents.where(F.col("source") == "src3"), documents.where(F.col("source") != "src3"), again])


@query("j1_latest_per_id", f"""WITH {B.LEDGER}
SELECT batch_id, max(event_id) AS event_id, count(*) AS n FROM ledger GROUP BY batch_id""")
def j1_latest(spark, sf):
    events = B.ledger(spark, sf)
    return ingest.latest_per_key(events, ["batch_id"], ["event_id"], columns=["batch_id", "event_id"], count="n")


@query("j2_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j2(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id").join(B.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("f2_bucketed_join", f"""WITH {B.SPEECHES}
SELECT s.speech_id, date, author, country, title, quality, toxic
FROM speeches s JOIN labels l ON s.speech_id = concat('speech_', CAST(l.doc_id AS VARCHAR))""")
def f2_bucketed(spark, sf):
    """Both sides bucketed by the id: the join needs no exchange."""
    columns = B.speeches(spark, sf).select("speech_id", "date", "author", "country", "title")
    sides = [write_bucketed(df, scratch_path(spark, "bucketed"), "speech_id", 8) for df in (columns, _scored_documents(spark, sf))]
    return joins.join_by_key(*sides)


@query("j1_bucketed_latest", f"""WITH {B.LEDGER}
SELECT batch_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, count(*) AS n FROM ledger GROUP BY batch_id""")
def j1_bucketed(spark, sf):
    """The latest event of each batch of a bucketed table, without an exchange."""
    events = B.ledger(spark, sf).select("batch_id", "event_id", "status")
    return latest_of(write_bucketed(events, scratch_path(spark, "bucketed"), "batch_id", 8), "batch_id", "event_id", ["event_id", "status"], count="n")
