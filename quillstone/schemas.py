"""Table schemas and the constants of the query semantics."""

from __future__ import annotations

DOCUMENTS = "id string, filename string, content_hash string, file_path string, num_pages int, status string, created_at timestamp"
PAGES = "doc_id string, page_number int, printed_page string, text string, char_count int, low_text boolean"
CHUNKS = "id string, doc_id string, chunk_index int, page_start int, page_end int, char_offset int, text string, token_count int, content_hash string"
RESPONSES = "content_hash string, prompt_version string, response_text string, created_at timestamp"
FACTS = "id string, doc_id string, chunk_id string, entity string, metric string, fact_type string, value string, unit string, period_label string, period_start string, period_end string, basis string, status string, quote string, confidence double, page_number int, printed_page string, dimensions string, fact_seq long"
REJECTIONS = "doc_id string, chunk_id string, stage string, reason string, raw_json string, created_at timestamp"

#: Fixed values.
LOW_TEXT_CHARS = 40
CHUNK_CHARS = 3500
CHUNK_OVERLAP = 500
BOUNDARY_REACH = 600
BOUNDARIES = ("\n\n", "\n", ". ", "; ")
PAGE_BREAK = "\n\n"
QUOTE_CHARS = 12
RAW_CHARS = 2000
PROMPT_VERSION = "v1"
FENCE = r"^```(?:json)?\s*|\s*```$"
NO_ARRAY = "no JSON array found in response"
BAD_JSON = "response is not valid JSON: {}"
NOT_ARRAY = "expected a JSON array, got {}"
NOT_OBJECT = "candidate is not an object: {}"
MISSING = "missing or blank field: {}"
UNKNOWN_TYPE = "unknown fact_type: {}"
SHORT_QUOTE = "quote too short to be evidence"
BAD_CONFIDENCE = "confidence is not a number"
FACT_TYPES = ("numeric", "semantic")
REQUIRED_FIELDS = ("entity", "metric", "fact_type", "quote")
OPTIONAL_FIELDS = ("value", "unit", "period_label", "period_start", "period_end", "basis", "status")

EDGE_LINES = 6
EDGE_LINE_CHARS = 70
MOST_PRINTED = 3000
VOTE_WINDOW = 6
LEAST_VOTES = 2
SHEET_FACTORS = (1, 2)
SHEET_PREFERENCE = 1.2

TOLERANCE = 0.05
OVERLAP_EQUAL = 0.2
OVERLAP_DIFFERING = 0.7
OVERLAP_SEMANTIC = 0.34
VALUE_OVERLAP = 0.75
VALUE_TOKENS = 5
LEAST_UNION = 3

ENTITY_STOP = ("mr", "mrs", "ms", "dr", "the", "limited", "ltd", "inc", "llp", "pvt", "private", "company", "co")
METRIC_STOP = (
    "the", "a", "an", "of", "for", "on", "in", "and", "or", "to", "as", "basis", "from", "with", "at", "is", "was", "were", "status", "role",
    "by", "this", "total", "amount", "number", "value", "net", "gross", "balance", "closing", "opening", "expense", "expenses", "cost", "costs",
    "standalone", "consolidated", "office", "address",
)
PERCENT_UNITS = ("percent", "%", "per cent")
PERCENT_WORDS = ("growth", "rate", "ratio", "margin", "deficit", "inflation", "yield", "participation", "percentage")
RELATIONS = ("corroboration", "contradiction", "context_reconcilable")
