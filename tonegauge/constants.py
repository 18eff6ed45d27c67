"""Fixed values that results depend on: field names, ranges, word lists, prices, markers."""

# --- scored record -----------------------------------------------------------------------------
TOP_FIELDS = (
    "hawkish_dovish_score", "topics", "uncertainty", "forward_guidance_strength",
    "key_sentences", "market_impact", "summary",
)
TOPIC_FIELDS = ("inflation", "growth", "financial_stability", "labor_market", "international")
MARKET_FIELDS = ("stocks", "bonds", "currency", "reasoning")
IMPACT_FIELDS = ("stocks", "bonds", "currency")
IMPACT_DOMAIN = ("rise", "fall", "neutral")
SCORE_RANGE = (-100, 100)
LEVEL_RANGE = (0, 100)

# --- flat record -------------------------------------------------------------------------------
MEAN_METRICS = (
    "hawkish_dovish_score", "uncertainty", "forward_guidance_strength",
    "topic_inflation", "topic_growth", "topic_financial_stability",
    "topic_labor_market", "topic_international",
)
IMPACT_METRICS = ("market_impact_stocks", "market_impact_bonds", "market_impact_currency")
DIFFUSION_METRICS = ("stocks_diffusion_index", "bonds_diffusion_index", "currency_diffusion_index")
INDEX_METRICS = MEAN_METRICS + DIFFUSION_METRICS
KEY_COLUMNS = (
    "date", "author", "country", "hawkish_dovish_score", "uncertainty",
    "forward_guidance_strength", "topic_inflation", "topic_growth",
)

# --- requests ----------------------------------------------------------------------------------
REQUEST_FIELDS = ("custom_id", "method", "url", "body")
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"
MODEL_NAME = "gpt-4o-2024-08-06"
RESPONSE_FORMAT = "json_object"
SYSTEM_MESSAGE = "You rate the policy tone of central bank speeches and answer in JSON."
TEMPERATURE = {"full": 0.3, "reduced": 0.0}
TEXT_MARKER = "**Speech Text:**"
TASK_MARKER = "**Your Task:**"
MAX_TEXT_TOKENS = 8000
CHARS_PER_TOKEN = 4
TRUNCATION_NOTE = "\n\n[Speech truncated due to length]"
OUTPUT_TOKENS_PER_REQUEST = 500
CHUNK_TOKENS = {"full": 80_000, "reduced": 75_000}

# --- prices ------------------------------------------------------------------------------------
REALTIME_PER_1K = (0.0025, 0.010)
BATCH_PER_1K = (0.00125, 0.005)
PER_1M = (2.50, 10.00)
BATCH_DISCOUNT = 0.50
FLAT_COST_PER_REQUEST = 0.0075
MINUTES_PER_CHUNK = (3, 5)

# --- audit -------------------------------------------------------------------------------------
HAWKISH_TERMS = (
    "inflation", "price pressure", "tighten", "raise rates", "increase rates",
    "restrictive", "normalize", "reduce accommodation", "upside risk",
)
DOVISH_TERMS = (
    "support growth", "accommodative", "lower rates", "cut rates", "reduce rates",
    "stimulus", "downside risk", "sluggish", "weak", "ease",
)
VERDICTS = {
    ("hawkish", True): "REASONABLE - Score indicates hawkish stance, speech contains more hawkish indicators",
    ("hawkish", False): "QUESTIONABLE - Score is hawkish but speech has more dovish indicators",
    ("dovish", True): "REASONABLE - Score indicates dovish stance, speech contains more dovish indicators",
    ("dovish", False): "QUESTIONABLE - Score is dovish but speech has more hawkish indicators",
    ("neutral", True): "REASONABLE - Score is neutral, speech has balanced or few indicators",
    ("neutral", False): "QUESTIONABLE - Score is neutral but speech shows clear directional bias",
}

# --- job states --------------------------------------------------------------------------------
STATUS_CLASSES = {
    "full": {
        "completed": ("completed",),
        "in_progress": ("in_progress", "validating"),
        "failed": ("failed",),
    },
    "reduced": {
        "completed": ("completed",),
        "in_progress": ("validating", "in_progress", "finalizing"),
        "failed": ("failed", "expired", "cancelled"),
    },
}
SETTLED_STATES = ("completed", "in_progress")

# --- metric catalogue: metric, family, neutral, low, high, title, scale note --------------------
METRIC_CATALOG = (
    ("hawkish_dovish_score", "policy", 0.0, -100.0, 100.0, "Hawkish/Dovish Score", "0=neutral, +100=hawkish, -100=dovish"),
    ("uncertainty", "policy", None, -1.0, 100.0, "Uncertainty", "0=confident, 100=uncertain"),
    ("forward_guidance_strength", "policy", None, -1.0, 100.0, "Forward Guidance Strength", "0=none, 100=explicit commitment"),
    ("speech_count", "policy", None, 1.0, 6.0, "Speech Count", None),
    ("topic_inflation", "topic", None, -1.0, 100.0, "Inflation", "0-100, higher=more emphasis"),
    ("topic_growth", "topic", None, -1.0, 100.0, "Growth", "0-100, higher=more emphasis"),
    ("topic_financial_stability", "topic", None, -1.0, 100.0, "Financial Stability", "0-100, higher=more emphasis"),
    ("topic_labor_market", "topic", None, -1.0, 100.0, "Labor Market", "0-100, higher=more emphasis"),
    ("topic_international", "topic", None, -1.0, 100.0, "International", "0-100, higher=more emphasis"),
    ("stocks_diffusion_index", "market", 50.0, 0.0, 100.0, "Stocks Diffusion", "50=neutral, 100=rise, 0=fall"),
    ("bonds_diffusion_index", "market", 50.0, 0.0, 100.0, "Bonds Diffusion", "50=neutral, 100=rise, 0=fall"),
    ("currency_diffusion_index", "market", 50.0, 0.0, 100.0, "Currency Diffusion", "50=neutral, 100=rise, 0=fall"),
)
ZERO_DISPLAY_VALUE = 0.01
