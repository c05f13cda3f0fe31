"""Fixed values. Results depend on these exact texts and numbers."""

# --- URL keys -------------------------------------------------------------
TRACKING_PREFIXES = ("utm_",)
TRACKING_NAMES = ("gclid", "fbclid", "mc_eid", "mc_cid", "_hsenc", "_hsmi")
DEFAULT_PORTS = {"http": 80, "https": 443}

# --- page text ------------------------------------------------------------
MIN_USABLE_CHARS = 500
SHELL_TEST_BELOW = 3000
SHELL_TEST_PREFIX = 4000
SHELL_MARKERS = (
    "enable javascript",
    "please enable js",
    "you need to enable javascript",
    "checking your browser",
    "captcha",
    "are you a human",
    "access denied",
    "cf-browser-verification",
    "request unsuccessful",
    "incapsula",
    "ddos protection",
)
DROPPED_SUBTREES = ("script", "style", "noscript", "template", "svg")
DEAD_STATUSES = (401, 404, 410)
READER_MIN_CHARS = 500
EXTRACT_MIN_CHARS = 200
EXCERPT_CHARS = 4000
DIGEST_THRESHOLD = 8000
RESULT_CHARS = 600
TRUNCATION_SUFFIX = "\n\n[...truncated; digest unavailable...]"

# --- caches ---------------------------------------------------------------
TTL_DAYS = 30
DEAD_TTL_DAYS = 90
SEARCH_CACHE_RUNG = "search"

# --- provider health ------------------------------------------------------
COOLDOWN_STATUSES = (429, 432, 433)
COOLDOWN_SECONDS = 3600
BREAKER_FAILURES = 2
BREAKER_SECONDS = 120
BATCH_SIZE = 20

# --- fetch errors -----------------------------------------------------------
DEAD_FRESH = "dead URL (HTTP %d) — re-search, do not retry"
DEAD_CACHED = "dead URL (HTTP %d) — re-search"
THIN_ERROR = "thin native body; escalation rungs could not improve it"
THIN_PAID_ERROR = "thin native body; Tavily could not improve it"
FAILED_ERROR = "no usable content"
FAILED_EXHAUSTED_ERROR = "no usable content (Tavily credits exhausted)"
HTTP_ERROR = "HTTPError %d"
NOT_EXTRACTED_ERROR = "not extracted (fallback off)"
MISSING_ERROR = "not a URL and not a file"

# --- search ---------------------------------------------------------------
SEARCH_JOB_RESULTS = 6
LIBRARY_RESULTS = 5
FREE_ENGINES = ("ddg", "brave", "claude_cli", "serper")
LITE_LINK = r"""<a rel="nofollow" href="([^"]+)" class='result-link'>(.*?)</a>"""
LITE_SNIPPET = r"""class='result-snippet'[^>]*>(.*?)</td>"""
LITE_REDIRECT = "duckduckgo.com/l/"
LITE_REDIRECT_PARAM = r"uddg=([^&]+)"
LITE_BLOCK_WORDS = ("anomaly", "botnet", "challenge-form")

# --- costs ----------------------------------------------------------------
GATED_REQUEST_USD = 0.005
DIGEST_USD = 0.002
EXTRACT_CREDITS = {"basic": 1, "advanced": 2}
ONE_TIME_FREE = {"parallel": 18_000}
MONTHLY_FREE = {
    "brave": 2000,
    "serper": 2500,
    "exa": 1000,
    "jina": None,
    "tavily": 1000,
    "parallel": None,
}

# --- watchdog -------------------------------------------------------------
WATCHDOG_WINDOW = 25
WATCHDOG_MIN_RATE = 0.55

# --- accounts -------------------------------------------------------------
NET_NEW = "net-new"
KNOWN_STATUS_DEFAULT = "prior-contact"
MATCH_NOTE = "matched research.known_companies"
NO_TABLE_NOTE = "no known-companies DB configured"
SUPPRESSED_STATUSES = ("do-not-contact", "customer")

# --- text scan ------------------------------------------------------------
SECRET_RULE = (
    r"""(API_KEY|APIKEY|TOKEN|SECRET|PASSWORD|BEARER)["' ]*[:=]\s*["']?[A-Za-z0-9_+/-]{24,}"""
)
SECRET_ALLOWED = r"(<[a-z_]+>|your[_-]|example|placeholder|changeme|xxxx|user:pass|localhost)"
PRIVATE_KEY_RULE = r"BEGIN [A-Z ]*PRIVATE KEY"
HOME_PATH_RULE = r"/Users/[A-Za-z0-9._-]+/"
NETWORK_KEY_RULES = (
    r"gh api .*contents/\.env",
    r"eval .*gh api",
    r"curl .*contents/\.env",
)
