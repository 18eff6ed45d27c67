"""Explicit schemas in DDL, one per dataset; nothing in the engine infers a schema."""

SPEECHES = (
    "date DATE, author STRING, country STRING, title STRING, description STRING, text STRING, "
    "mistral_ocr STRING, clean_text STRING, url STRING, year INT"
)
SAMPLE = f"speech_id STRING, {SPEECHES}"

REQUEST = (
    "custom_id STRING, method STRING, url STRING, "
    "body STRUCT<model: STRING, messages: ARRAY<STRUCT<role: STRING, content: STRING>>, "
    "response_format: STRUCT<type: STRING>, temperature: DOUBLE>"
)

ENVELOPE = (
    "custom_id STRING, response STRUCT<status_code: INT, "
    "body: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>"
)

SENTIMENT = (
    "speech_id STRING, hawkish_dovish_score DOUBLE, topic_inflation DOUBLE, topic_growth DOUBLE, "
    "topic_financial_stability DOUBLE, topic_labor_market DOUBLE, topic_international DOUBLE, "
    "uncertainty DOUBLE, forward_guidance_strength DOUBLE, market_impact_stocks STRING, "
    "market_impact_bonds STRING, market_impact_currency STRING, market_impact_reasoning STRING, "
    "summary STRING, key_sentences STRING"
)
PREPARED = f"date DATE, author STRING, country STRING, title STRING, {SENTIMENT}"

DAILY_INDEX = (
    "date DATE, hawkish_dovish_score DOUBLE, uncertainty DOUBLE, forward_guidance_strength DOUBLE, "
    "topic_inflation DOUBLE, topic_growth DOUBLE, topic_financial_stability DOUBLE, "
    "topic_labor_market DOUBLE, topic_international DOUBLE, stocks_diffusion_index DOUBLE, "
    "bonds_diffusion_index DOUBLE, currency_diffusion_index DOUBLE, speech_count INT"
)

LEDGER = (
    "chunk_name STRING, chunk_number INT, batch_id STRING, file_id STRING, num_requests BIGINT, "
    "status STRING, submitted_at TIMESTAMP, updated_at TIMESTAMP, checked_at TIMESTAMP, "
    "completed_at TIMESTAMP, failed_at TIMESTAMP, resubmitted BOOLEAN, previous_batch_id STRING, "
    "output_file STRING, error STRING, resubmit_error STRING"
)
