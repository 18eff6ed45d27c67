"""Registered queries: a Spark callable and, where DuckDB can state the same, its SQL.

The shared frames below map the given tables to the engine's datasets. Their column expressions are
plain SQL that Spark and DuckDB read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, so that two engines' sums of doubles compare equal."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


# speeches: one per document
SPEECH_COLUMNS = {
    "doc_id": "doc_id",
    "speech_id": "concat('speech_', CAST(doc_id AS STRING))",
    "date": "DATE '2022-01-01' + CAST((doc_id * 7) % 730 AS INT)",
    "author": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END",
    "country": "lang",
    "title": "concat('Document ', CAST(doc_id AS STRING))",
    "text": "text",
}
SPEECHES = f"speeches AS (SELECT {_select_list(SPEECH_COLUMNS)} FROM documents)"


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "documents"), SPEECH_COLUMNS)


# prepared records: one per order
PREPARED_COLUMNS = {
    "order_key": "o_orderkey",
    "date": "CAST(o_orderdate AS DATE)",
    "author": "CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE concat('Author ', CAST(o_custkey % 40 AS STRING)) END",
    "country": "o_orderpriority",
    "title": "concat('Order ', CAST(o_orderkey AS STRING))",
    "speech_id": "concat('speech_', CAST(o_orderkey AS STRING))",
    "hawkish_dovish_score": "CAST((o_orderkey * 37 + o_custkey * 11) % 201 - 100 AS DOUBLE)",
    "topic_inflation": "CAST((o_orderkey * 7) % 101 AS DOUBLE)",
    "topic_growth": "CAST((o_orderkey * 11 + o_custkey) % 101 AS DOUBLE)",
    "topic_financial_stability": "CAST((o_custkey * 3) % 101 AS DOUBLE)",
    "topic_labor_market": "CAST((o_orderkey + o_custkey) % 101 AS DOUBLE)",
    "topic_international": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 3) % 101 AS DOUBLE) END",
    "uncertainty": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 5003 END",
    "forward_guidance_strength": "CAST(o_custkey % 101 AS DOUBLE)",
    "market_impact_stocks": "CASE o_orderstatus WHEN 'P' THEN 'rise' WHEN 'O' THEN 'neutral' ELSE 'fall' END",
    "market_impact_bonds": "CASE o_orderkey % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall' WHEN 2 THEN 'neutral' ELSE NULL END",
    "market_impact_currency": "CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall' WHEN 2 THEN 'neutral' WHEN 3 THEN 'strengthen' ELSE NULL END",
    "market_impact_reasoning": "concat('Status ', o_orderstatus)",
    "summary": "concat('Summary of order ', CAST(o_orderkey AS STRING))",
    "key_sentences": "concat('first|', o_orderstatus)",
}
PREPARED = f"prepared AS (SELECT {_select_list(PREPARED_COLUMNS)} FROM orders)"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "orders"), PREPARED_COLUMNS)


# responses: one line per document, with every kind of defect the parser and the rules know
_K = "(doc_id % 23)"
_CONTENT = f"""CASE {_K} WHEN 0 THEN 'Sorry, no JSON' ELSE concat(
'{{"hawkish_dovish_score": ', CASE {_K} WHEN 3 THEN '"45"' WHEN 4 THEN '150' WHEN 11 THEN 'true' WHEN 12 THEN 'null' WHEN 13 THEN '12.5' ELSE CAST((doc_id * 7 + n_chars) % 201 - 100 AS STRING) END,
', "topics": ', CASE {_K} WHEN 2 THEN 'null' ELSE concat('{{"inflation": ', CAST(n_chars % 101 AS STRING),
CASE {_K} WHEN 8 THEN '' ELSE concat(', "growth": ', CAST((n_chars + doc_id) % 101 AS STRING)) END,
', "financial_stability": ', CAST((doc_id * 3) % 101 AS STRING), ', "labor_market": ', CASE {_K} WHEN 17 THEN '-1' ELSE CAST((doc_id * 5) % 101 AS STRING) END,
', "international": ', CAST((doc_id * 11) % 101 AS STRING), '}}') END,
CASE {_K} WHEN 1 THEN '' ELSE concat(', "uncertainty": ', CAST((doc_id * 13) % 101 AS STRING)) END,
', "forward_guidance_strength": ', CAST((doc_id * 17) % 101 AS STRING),
', "key_sentences": ', CASE {_K} WHEN 6 THEN '[]' ELSE concat('["Sentence ', CAST(doc_id AS STRING), '", "source ', source, '"]') END,
', "market_impact": {{"stocks": "', CASE doc_id % 3 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall' ELSE 'neutral' END, '"',
CASE {_K} WHEN 10 THEN '' WHEN 14 THEN ', "bonds": null' ELSE ', "bonds": "neutral"' END,
', "currency": "', CASE {_K} WHEN 5 THEN 'strengthen' ELSE 'fall' END, '"',
CASE {_K} WHEN 9 THEN '' ELSE concat(', "reasoning": "In ', lang, '"') END, '}}',
CASE {_K} WHEN 9 THEN ', "reasoning": "At the top"' ELSE '' END,
', "summary": "', CASE {_K} WHEN 7 THEN '  ' ELSE concat('Summary of document ', CAST(doc_id AS STRING)) END, '"}}') END"""
RESPONSE_COLUMNS = {
    "doc_id": "doc_id",
    "chunk_number": "doc_id % 7 + 1",
    "raw": f"""concat('{{"custom_id": "speech_', CAST(doc_id AS STRING), '", "response": {{"status_code": ', CASE {_K} WHEN 15 THEN '500' ELSE '200' END,
', "body": {{"choices": [{{"message": {{"content": "', replace({_CONTENT}, '"', concat(chr(92), '"')), CASE {_K} WHEN 16 THEN '' ELSE '"}}}}]}}}}}}' END)""",
}
RESPONSES = f"responses AS (SELECT {_select_list(RESPONSE_COLUMNS)} FROM documents)"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "documents"), RESPONSE_COLUMNS)


# job events: the events table read as a ledger of chunks
LEDGER_COLUMNS = {
    "chunk_name": "concat('chunk', CAST(user_id AS STRING), '_input.jsonl')",
    "chunk_number": "CAST(user_id AS INT)",
    "batch_id": "concat('batch_', CAST(event_id % 900 AS STRING))",
    "num_requests": "CAST(floor(value) AS BIGINT)",
    "status": "CASE event_type WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'in_progress' WHEN 'signup' THEN 'validating' WHEN 'error' THEN 'failed' ELSE 'expired' END",
    "updated_at": "ts",
    "event_id": "event_id",
}
LEDGER = f"ledger AS (SELECT {_select_list(LEDGER_COLUMNS)} FROM events)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "events"), LEDGER_COLUMNS)
