"""Fixed values.

Every number and list here must equal the behaviour being reproduced;
they are stated plainly, in natural order, in one place.
"""

# --- fixed values: ranking constants -----------------------------------------
THREE_MONTHS_S = 7890000          # default age when the timestamp is missing
THREE_MONTHS_S_EVENT_INITIAL = 7776000  # the one profile that uses 90 days exactly
ONE_YEAR_S = 31536000
ONE_DAY_S = 86400.0
MAX_DOC_DECAY = 0.5               # doc_recency floor
PI_APPROX = 3.14159               # scale(x) = 2*atan(x/4)/3.14159
MAX_SCORE_BASE = 1000000000.0     # recency_bin_score base
BIN_MULTIPLIER_CLAMPED = 10000.0  # with relevance/10 clamped to [0, 9999]
BIN_MULTIPLIER_RAW = 1000000.0    # with raw relevance
VECTOR_DECAY = 0.8                # chat-message vector decay
FRESHNESS_MAX_AGE_S = 7776000     # linear freshness horizon (our definition)
DEFAULT_RERANK = 1000             # rerank-count of every two-phase profile

# --- fixed values: text scoring (our stated definitions) ---------------------
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
LEADING_SEP = r"^[^\p{L}\p{N}]+"
GRAM_SIZE = 3
NATIVE_POS_SCALE = 16.0           # 0.5/(1+first_pos/16)
NATIVE_TF_SATURATION = 9.0        # 0.5*least(1, ln(1+tf)/ln(9))

# --- fixed values: test parameters --------------------------------------------
NOW_S = 1706745600                # 2024-02-01 00:00:00 UTC
ALPHA = 0.5
RECENCY_DECAY_RATE = 0.1
BIN_SIZE_DAYS = 7.0
TEST_RERANK = 50

# --- fixed values: embedding request job --------------------------------------
EMBED_BATCH_SIZE = 512
UPSTREAM_CONCURRENCY = 1
REQUEST_TIMEOUT_MS = 1800000
MAX_RETRIES = 8
RETRY_BASE_MS = 1000
RETRY_CAP_MS = 60000
RETRY_JITTER_CAP_MS = 1000
PAYLOAD_LIMIT_BYTES = 200000000
EMBEDDING_WIDTH = 1024
ERROR_EXCERPT_CHARS = 2000
RETRY_STATUSES = [408, 409, 425, 429, 500, 502, 503, 504]
RETRY_PHRASES = ["model overloaded", "no permits available", "overloaded",
                 "too many requests", "temporarily unavailable"]
RETRY_ERROR_CODES = ["ECONNRESET", "ECONNREFUSED", "EHOSTUNREACH", "ENETUNREACH",
                     "ETIMEDOUT", "ESOCKETTIMEDOUT"]

# --- fixed values: logs, metrics, edge ----------------------------------------
LOG_RATE_LINES_PER_S = 10000
LOG_BURST_LINES = 20000
METRIC_INTERVALS_S = [10, 2]
RATE_LOGIN_PER_MIN = 5
RATE_LOGIN_BURST = 5
RATE_API_PER_MIN = 100
RATE_API_BURST = 50
STATIC_EXTENSIONS = ["css", "js", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot"]
