"""Values that results depend on: patterns, word lists, labels and message formats.

Nothing here is logic. Every entry is a fixed value: change one and findings,
tokens, rules or messages change with it.
"""

from __future__ import annotations

# --- line formats -----------------------------------------------------------

ACCESS_LINE = (
    r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+) "([^"]*)" "([^"]*)"$'
)
SYSLOG_LINE = (
    r"^(?:<\d+>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+([^\n]*)$"
)
SYSLOG_5424_LINE = (
    r"^<\d+>\d+ (\S+) (\S+) (\S+) (\S+) \S+ (?:-|(?:\[[^\]]*\])+) ?([^\n]*)$"
)
IPV4_IN_TEXT = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"

# phrase in the lower-cased message -> action, first hit wins
SYSLOG_ACTIONS = (
    ("failed password", "FAILED"),
    ("accepted password", "ACCEPTED"),
    ("accepted publickey", "ACCEPTED"),
    ("session opened", "SESSION_OPENED"),
    ("session closed", "SESSION_CLOSED"),
    ("invalid user", "INVALID_USER"),
    ("disconnected", "DISCONNECTED"),
    ("connection closed", "CONNECTION_CLOSED"),
    ("authentication failure", "AUTH_FAILED"),
)

# --- personal data ----------------------------------------------------------

IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = (
    r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}"
    r"|:(?::[0-9a-fA-F]{1,4}){1,7}"
    r"|::"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL_SENSITIVE = (
    r"https?://\S*\?(?:\S*[&?])?"
    r"(?:token|session|key|password|secret|api_key|access_token)=\S*"
)
PATH_IDS = r"/\d{3,}(?=/|$|\s)"

# name, pattern, token prefix; masking runs in this order
PII_PATTERNS = (
    ("ipv4", IPV4, "[IP_"),
    ("ipv6", IPV6, "[IPV6_"),
    ("email", EMAIL, "[EMAIL_"),
    ("url_sensitive", URL_SENSITIVE, "[URL_SENSITIVE_"),
    ("path_ids", PATH_IDS, "[ID_"),
)

IP_TOKEN = r"\[IP_[0-9a-f]+\]"
ANY_TOKEN = r"\[(?:IP|IPV6|EMAIL|URL_SENSITIVE|ID)_[0-9a-f]+\]"

# --- noise ------------------------------------------------------------------

SUSPICIOUS_PATH_PARTS = (
    "/admin", "/etc/passwd", "/wp-admin", "/wp-login", ".env", "/phpmyadmin", "/phpinfo",
)
SUSPICIOUS_STATUSES = (403, 404, 500)
STATIC_EXTENSIONS = (
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg",
    ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".pdf", ".zip",
)
HEALTH_PATHS = ("/health", "/healthz", "/ping", "/alive", "/ready")
KNOWN_BOTS = (
    "Googlebot", "Bingbot", "Baiduspider", "YandexBot", "DuckDuckBot", "Slurp",
    "facebookexternalhit", "Twitterbot", "LinkedInBot",
)
EXTENSION = r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$"

# --- detection --------------------------------------------------------------

SQLI_PATTERNS = (
    r"UNION\s+(ALL\s+)?SELECT",
    r"OR\s+1\s*=\s*1",
    r"'\s*--",
    r"%27",
    r"1\s*=\s*1",
    r"SELECT\s+.*\s+FROM",
)
TRAVERSAL_PATTERNS = (r"\.\./", r"\.\.%2[fF]", r"\.\.\\")
SCANNER_AGENTS = ("nikto", "sqlmap", "nmap", "dirbuster", "gobuster", "masscan", "wpscan")
BRUTE_PATHS = ("/login", "/auth", "/signin", "/wp-login.php", "/api/login")
BRUTE_STATUSES = (401, 403)
BRUTE_METHODS = ("POST", "PUT")
FUZZ_STATUSES = (403, 404)
RULE_CONFIDENCE = 0.95

REQUEST_IN_LINE = r'"(?:GET|POST|PUT|DELETE|PATCH|HEAD) ([^ ]+) HTTP'

# --- enumerations -----------------------------------------------------------

CATEGORIES = ("normal", "suspicious", "malicious", "scan", "bruteforce", "exploit_attempt")
SEVERITIES = ("low", "medium", "high", "critical")  # ascending
ACTIONS = ("alert_only", "block_ip", "block_path", "rate_limit", "investigate")
CRITICAL_SEVERITIES = ("high", "critical")
CRITICAL_RULE_TYPES = ("ufw", "nginx_deny")

SEVERITY_ICONS = {"critical": "\U0001f534", "high": "\U0001f7e0", "medium": "\U0001f7e1",
                  "low": "\U0001f7e2"}
CATEGORY_LABELS = {"normal": "Normal", "suspicious": "Suspicious", "malicious": "Malicious",
                   "scan": "Scan", "bruteforce": "Brute Force",
                   "exploit_attempt": "Exploit Attempt"}
STATUS_LABELS = {"pending": "awaiting approval", "approved": "approved", "rejected": "rejected",
                 "expired": "expired", "executed": "executed", "failed": "failed"}

MARKDOWN_SPECIAL = r"([_*\[\]()~`>#+\-=|{}.!])"
