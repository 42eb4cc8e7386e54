"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — markers, tool list, defaults and limits, stated as text.
"""

# --- fixed values: markers written into tool calls ---------------------------
OUTPUT_MARKER = "[Output removed to save context - information superseded or no longer needed]"
ERROR_INPUT_MARKER = "[input removed due to failed tool call]"

# --- fixed values: protected tools (compared case-insensitively) -------------
PROTECTED_TOOLS = (
    "task",
    "skill",
    "todowrite",
    "todoread",
    "batch",
    "plan_enter",
    "plan_exit",
    "write",
    "edit",
    "patch",
    "question",
)

# --- fixed values: error-document prefixes (compared case-insensitively) -----
ERROR_PREFIXES = ("[error]", "[sessionsift] error")

# --- fixed values: defaults --------------------------------------------------
DEFAULT_QUERY = "Optimize the most relevant context for compaction."
DEFAULT_TIMEOUT_MS = 300000
DEFAULT_MIN_CHARS = 2000
DEFAULT_COMPRESSION_RATE = 0.5
DEFAULT_MAX_CHUNKS = 6
DEFAULT_DEDUPE_THRESHOLD = 0.9
DEFAULT_PRUNE_BUDGET_CHARS = 4000
DEFAULT_AUTO_COMPRESSION_CHARS = 4000
DEFAULT_RERANKER_MODEL = "BAAI/bge-reranker-large"
DEFAULT_EMBED_MODEL = "all-MiniLM-L6-v2"
DEFAULT_COMPRESSOR_MODEL = ""

PURGE_ERROR_TURNS = 4
MAX_TRANSCRIPT_ENTRIES = 200
MAX_TOOL_DOC_CHARS = 2000
PREFILTER_MIN_CAP = 40          # cap = max(40, 4 * max_chunks)
PREFILTER_CHUNK_FACTOR = 4

# --- fixed values: configuration keys ----------------------------------------
SAFE_CONFIG_KEYS = (
    "timeout_ms",
    "min_chars",
    "compression_rate",
    "max_chunks",
    "dedupe_threshold",
    "total_prune_budget_chars",
    "auto_compression_chars",
    "reranker_model",
    "embed_model",
    "compressor_model",
    "model_limits",
)
STRING_CONFIG_KEYS = ("reranker_model", "embed_model", "compressor_model")

# --- fixed values: result texts ----------------------------------------------
OPTIMIZED_HEADER = "## Optimized Context\n\n"
MSG_PREFIX = "[sessionsift] "
REASON_NO_DOCS = "no compaction documents were provided."
RESULTS_CSV_HEADER = "timestamp,cli,session_id,trigger,initial_chars,result_chars,saved_chars"
STATS_WINDOWS = ("last", "session", "today", "week", "month", "overall")
STATS_METRICS = ("compactions", "initial chars", "result chars", "saved chars", "saved %")

# --- lexical defaults (our own substitute for the neural models) -------------
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DIGITS = 6
