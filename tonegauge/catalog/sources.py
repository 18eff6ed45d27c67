"""Scans, sinks and contracts (A)."""

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query
from tonegauge.catalog.texts import PROMPT_SQL
from tonegauge.operators import contracts, profile
from tonegauge.operators.parse import classify_responses
from tonegauge.operators.requests import build_requests, request_lines
from tonegauge.session import scratch_path
from tonegauge.sources import readers, splits, writers


@query("a1_parquet_scan", "SELECT * FROM customer")
def a1(spark, sf):
    source = f"{sf}/customer.parquet"
    return readers.read_cached(spark, scratch_path(spark, "cache"), source, readers.read_parquet(spark, source).schema)


_SAMPLE_COLUMNS = "speech_id, date, author, country, title, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_length"
_SAMPLE_SQL = f"WITH {B.SPEECHES} SELECT {_SAMPLE_COLUMNS} FROM speeches"


def _sample_view(df):
    return df.select(
        "speech_id", "date", "author", "country", "title",
        F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("text_length"),
    )


_SAMPLE_SCHEMA = "doc_id BIGINT, speech_id STRING, date DATE, author STRING, country STRING, title STRING, text STRING"


@query("a2_csv_scan", _SAMPLE_SQL)
def a2(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_table(B.speeches(spark, sf), path, "csv")
    return _sample_view(readers.read_csv(spark, path, _SAMPLE_SCHEMA))


@query("a2_split_csv", _SAMPLE_SQL)
def a2_split(spark, sf):
    """Files with line breaks and quotes inside their fields, each read by several tasks."""
    path = scratch_path(spark, "split_csv")
    writers.write_table(B.speeches(spark, sf), path, "csv")
    return _sample_view(splits.read_split_csv(spark, path, _SAMPLE_SCHEMA, size=splits.even_bytes(spark, path)))


@query("a3_preferred_scan", _SAMPLE_SQL)
def a3(spark, sf):
    path = scratch_path(spark, "preferred")
    writers.write_table(B.speeches(spark, sf), f"{path}.csv", "csv")
    return _sample_view(readers.read_preferred(spark, f"{path}.parquet", f"{path}.csv", _SAMPLE_SCHEMA))


@query("a4_request_scan", f"""WITH {B.SPEECHES}, {PROMPT_SQL}
SELECT speech_id AS custom_id, '{K.REQUEST_METHOD}' AS method, '{K.REQUEST_URL}' AS url, '{K.MODEL_NAME}' AS model,
  CAST(2 AS BIGINT) AS messages, {K.TEMPERATURE['full']}::DOUBLE AS temperature, md5(prompt) AS content_md5 FROM prompts""")
def a4(spark, sf):
    path = scratch_path(spark, "requests")
    request_lines(build_requests(B.speeches(spark, sf))).write.text(path)
    return readers.read_requests(spark, path).select(
        "custom_id", "method", "url", F.col("body.model").alias("model"),
        F.size("body.messages").cast("bigint").alias("messages"), F.col("body.temperature").alias("temperature"),
        F.md5(F.col("body.messages")[1]["content"].cast("binary")).alias("content_md5"),
    )


@query("a5_response_scan", f"""WITH {B.RESPONSES}
SELECT CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.custom_id') END AS custom_id, md5(raw) AS raw_md5 FROM responses""")
def a5(spark, sf):
    path = scratch_path(spark, "responses")
    B.responses(spark, sf).select("raw").write.text(path)
    lines = classify_responses(readers.read_lines(spark, path))
    return lines.select("custom_id", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query("a6_chunk_results_scan", f"""WITH {B.RESPONSES}
SELECT chunk_number, count(*) AS lines, CAST(sum(length(raw)) AS BIGINT) AS characters FROM responses GROUP BY chunk_number""")
def a6(spark, sf):
    path = scratch_path(spark, "chunks")
    named = B.responses(spark, sf).withColumn("part", F.format_string("chunk%02d_results", "chunk_number"))
    named.select("raw", "part").write.partitionBy("part").text(path)
    lines = readers.read_chunk_results(spark, path, "part=chunk*_results")
    return lines.groupBy("chunk_number").agg(F.count("*").alias("lines"), F.sum(F.length("raw")).cast("bigint").alias("characters"))


@query("a7_table_sink", "SELECT 'csv' AS format, * FROM labels UNION ALL SELECT 'parquet' AS format, * FROM labels")
def a7(spark, sf):
    labels, path = B.table(spark, sf, "labels"), scratch_path(spark, "table")
    parts = []
    for name in ("csv", "parquet"):
        writers.write_table(labels, f"{path}-{name}", name)
        back = readers.read_csv(spark, f"{path}-csv", labels.schema) if name == "csv" else readers.read_parquet(spark, f"{path}-parquet")
        parts.append(back.select(F.lit(name).alias("format"), "*"))
    return parts[0].unionByName(parts[1])


@query("a8_chunk_sink", f"""WITH {B.RESPONSES}
SELECT concat('chunk0', CAST(chunk_number AS VARCHAR), '_input') AS chunk_file, count(*) AS lines FROM responses GROUP BY chunk_number""")
def a8(spark, sf):
    path = scratch_path(spark, "sink")
    writers.write_chunks(B.responses(spark, sf), path, "raw", "chunk_number", ["doc_id"], split=True)
    return spark.read.schema("value STRING, chunk_file STRING").text(path).groupBy("chunk_file").agg(F.count("*").alias("lines"))


@query("a9_report_sink", """SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS toxic, CAST(NULL AS VARCHAR) AS note,
  round(avg(quality), 6) AS mean_quality FROM labels""")
def a9(spark, sf):
    path = scratch_path(spark, "report")
    labels = B.table(spark, sf, "labels")
    stats = F.struct(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    quality = F.struct(F.round(F.avg("quality"), 6).alias("mean"))
    writers.write_report(labels.agg(stats.alias("counts"), quality.alias("quality"), F.lit(None).cast("string").alias("note")), path)
    schema = "counts STRUCT<total: BIGINT, toxic: BIGINT>, quality STRUCT<mean: DOUBLE>, note STRING"
    return spark.read.schema(schema).json(path).select("counts.total", "counts.toxic", "note", F.col("quality.mean").alias("mean_quality"))


@query("a9_report_rows", "SELECT quality, count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY quality")
def a9_rows(spark, sf):
    path = scratch_path(spark, "reports")
    labels = B.table(spark, sf, "labels")
    writers.write_report(labels.groupBy("quality").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("toxic")), path)
    return spark.read.schema("quality INT, total BIGINT, toxic BIGINT").json(path)


@query("a10_required_columns", "SELECT 'o_reviewer' AS missing, count(*) AS orders FROM orders")
def a10(spark, sf):
    orders = B.table(spark, sf, "orders")
    contracts.require_columns(orders, ["o_orderkey", "o_orderdate"], "orders")
    missing = ",".join(sorted(contracts.missing_columns(orders, ["o_orderkey", "o_reviewer"])))
    return orders.agg(F.lit(missing).alias("missing"), F.count("*").alias("orders")).select("missing", "orders")


@query("a11_dataset_description", f"""WITH {B.PREPARED}
SELECT count(*) AS total_rows, count(DISTINCT country) AS groups, min(date) AS earliest, max(date) AS latest,
  CAST(max(date) - min(date) AS BIGINT) AS span_days, {len(B.PREPARED_COLUMNS)} AS columns FROM prepared""")
def a11(spark, sf):
    return profile.describe_dataset(B.prepared(spark, sf))


_A11_COLUMNS = " UNION ALL ".join(f"SELECT 'column' AS part, '{name}' AS label, CAST({i} AS INT) AS place, CAST(NULL AS BIGINT) AS rows" for i, name in enumerate(B.PREPARED_COLUMNS))


@query("a11_dataset_contents", f"""WITH {B.PREPARED}
{_A11_COLUMNS}
UNION ALL SELECT 'group', country, NULL, count(*) FROM prepared WHERE country IS NOT NULL GROUP BY country
UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), NULL, count(*) FROM prepared WHERE date IS NOT NULL GROUP BY year(date)""")
def a11_contents(spark, sf):
    return profile.dataset_contents(B.prepared(spark, sf))
