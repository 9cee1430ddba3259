"""Regular expressions and word lists that must equal the reference's.

Fixed values (kept verbatim in meaning; written for Java regex and RE2,
which both run them): secret detection, prompt-injection redaction, the
repository scan filters and the path rules.
"""

# Secret patterns of the memory-ingest validator (case-insensitive).
SECRET_PATTERNS = (
    r"api[_-]?key",
    r"bearer\s+[A-Za-z0-9._-]+",
    r"-----BEGIN(.*?)PRIVATE KEY-----",
)
SECRET_RE = "(?i)(" + "|".join(SECRET_PATTERNS) + ")"

# Prompt-injection redaction, applied in this order, each
# global and case-insensitive, replacement "[FILTERED]".
REDACTION_PATTERNS = (
    r"ignore previous instructions",
    r"ignore all previous",
    r"reveal .* key",
    r"system prompt",
    r"password",
    r"api[_-]?key",
    r"bearer\s+[A-Za-z0-9._-]+",
    r"-----BEGIN(.*?)PRIVATE KEY-----",
)
FILTERED = "[FILTERED]"

# Repository secret scan (include is case-insensitive, the
# allow-list exclusion is case-sensitive).
SCAN_INCLUDE_RE = r"(?i)(api[_-]?key|secret|token|password|PRIVATE KEY|BEGIN [A-Z ]*PRIVATE KEY|Bearer\s+[A-Za-z0-9.*-]+)"
SCAN_EXCLUDE_RE = r"example|placeholder|your-|FILTERED|dummy|test"
CREDENTIAL_KEY_RE = r'(?i)("accessToken"|"refreshToken"|"clientSecret"|"privateKey")'
SECRET_FILE_RE = r"(^|/)(.env(..*)?|.*.pem|.*.key|id_rsa|service_account.*.json)$"
ENV_FILE_RE = r"(^|/).env$"
SUSPICIOUS_DIFF_RE = r"(password|secret|token|key).*[=:].*[A-Za-z0-9]{10,}"

# Sandbox path rules.  Component characters are word
# characters (letters, digits, underscore), '-' and '.'.
SAFE_COMPONENT_RE = r"^[\p{L}\p{N}_.-]+$"
DANGEROUS_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".sh", ".bash", ".zsh", ".pyo", ".pyc")
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 100 * 1024 * 1024

# Error sanitisation vocabulary.
SENSITIVE_ERROR_WORDS = ("password", "secret", "key", "token", "credential",
                         "/workspace", "/tmp", "container", "docker")

# Mail recipient address check.
EMAIL_RE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
