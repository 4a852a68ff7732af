"""Word lists, patterns, labels and texts that results depend on.

They are data, not logic. Patterns are kept in the dialect they were published
in; ``functions.patterns`` adds the flags that make the JVM read them alike.
"""

# ---------------------------------------------------------------------------
# Sizes and defaults
# ---------------------------------------------------------------------------
MAX_MESSAGE_CHARS = 2000
MODEL_INPUT_CHARS = 512
CHARS_PER_TOKEN = 4
INJECTION_THRESHOLD = 0.8
TOXICITY_THRESHOLD = 0.5
PII_THRESHOLD = 0.5
SPAN_SCORE_THRESHOLD = 0.1
PII_CONFIDENCE = 0.95
TOKEN_LIMIT_CONFIDENCE = 1.0
DEFAULT_SECRETS_SCORE = 1.0
DEFAULT_INJECTION_SCORE = 0.9
DEFAULT_TOXICITY_SCORE = 0.8
EMPTY_MESSAGE_REASON = "message field cannot be empty"
SCAN_FAILED_REASON = "Scan failed: "
REDACTED_VALUE = "REDACTED"
RISK_SAFE = "SAFE"

# ---------------------------------------------------------------------------
# Personal-data patterns (case-sensitive)
# ---------------------------------------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?1?[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD_PATTERN = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"

# Name patterns (case-insensitive, group 1 is the name)
NAME_INTRO_PATTERN = r"(?:my name is|i am|i'm|call me|this is|name's|myself)\s+([A-Za-z][a-z]{1,}(?:\s+[A-Z][a-z]+)*)"
NAME_GREETING_PATTERN = r"(?:hi|hey|hello)[,\s]+(?:i(?:'m| am)\s+)?([A-Z][a-z]{1,}(?:\s+[A-Z][a-z]+)*)"

# Fixed value: redaction token
TOKEN_PATTERN = r"\[([A-Z_]+)_(\d+)\]"

# ---------------------------------------------------------------------------
# Credential patterns (case-insensitive), in report order
# ---------------------------------------------------------------------------
SECRET_PATTERNS = (
    ("API_KEY", r"""\b(?:api[_-]?key|apikey)\s*[=:]\s*['"]?([a-zA-Z0-9_-]{20,})['"]?"""),
    ("API_KEY", r"""\b(?:sk|pk|rk|ak)-[a-zA-Z0-9]{16,}"""),
    ("GITHUB_TOKEN", r"""\b(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,}"""),
    ("GOOGLE_API_KEY", r"""\bAIza[0-9A-Za-z\-_]{35}"""),
    ("PASSWORD", r"""\b(?:password|passwd|pwd)\s*[=:]\s*['"]?([^\s'">]+)['"]?"""),
    ("SECRET", r"""\b(?:secret|token|auth)\s*[=:]\s*['"]?([a-zA-Z0-9_-]{8,})['"]?"""),
    ("BEARER_TOKEN", r"""\bBearer\s+[a-zA-Z0-9._-]{20,}"""),
    ("AWS_KEY", r"""\baws_(?:access_key_id|secret_access_key)\s*[=:]\s*['"]?([A-Z0-9]{16,})['"]?"""),
)

# ---------------------------------------------------------------------------
# Reply tone and instruction per violation type
# ---------------------------------------------------------------------------
TONES = (
    ("toxicity", "calm and de-escalating"),
    ("injection", "lightly humorous and firm"),
    ("prompt_injection", "lightly humorous and firm"),
    ("jailbreak", "lightly humorous and firm"),
    ("pii", "warm and protective"),
    ("secrets", "serious and direct"),
    ("token_limit", "helpful and informative"),
)
INSTRUCTIONS = (
    ("toxicity", "acknowledge the frustration might exist, redirect the user warmly without being preachy"),
    ("injection", "let the user know their attempt didn't work without explaining why, keep it light"),
    ("prompt_injection", "let the user know their attempt didn't work without explaining why, keep it light"),
    ("jailbreak", "let the user know their attempt didn't work without explaining why, keep it light"),
    ("pii", "protect the user by asking them not to share personal information, make them feel safe not accused"),
    ("secrets", "firmly tell the user to remove sensitive credentials before proceeding"),
    ("token_limit", "politely ask the user to shorten their message and try again"),
)
DEFAULT_TONE = "professional and firm"
DEFAULT_INSTRUCTION = "redirect the user politely"

# Fixed value: reply prompt; places are type, confidence, length, tone, instruction
REPLY_PROMPT = (
    "A user message was blocked by the security system for: "
    "%s violation (%s confidence, %s message). "
    "Generate a %s response that will %s. "
    "Do NOT reference the user's actual message. "
    "Max 2 sentences. End with a soft redirect to what you can help with."
)

# Label boundaries (exclusive upper bound, label) and (lower bound, label)
LENGTH_LABELS = ((50, "very short"), (150, "short"), (400, "medium"))
LENGTH_LABEL_REST = "long"
CONFIDENCE_LABELS = ((0.9, "very high"), (0.7, "high"))
CONFIDENCE_LABEL_REST = "moderate"

# ---------------------------------------------------------------------------
# Our own values: no published rules exist for the parts below
# ---------------------------------------------------------------------------
# (name, case-insensitive pattern, weight)
INJECTION_RULES = (
    ("override", r"\b(?:ignore|disregard|forget)\s+(?:all\s+|any\s+)?(?:of\s+)?(?:the\s+|your\s+|my\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|rules?|prompts?|messages?)\b", 1.0),
    ("reveal_prompt", r"\b(?:reveal|show|print|repeat|tell\s+me)\s+(?:me\s+)?your\s+(?:system|hidden|initial)\s+(?:prompt|instructions?)\b", 0.95),
    ("jailbreak", r"\b(?:jailbreak|do\s+anything\s+now|dan\s+mode)\b", 0.95),
    ("no_limits_persona", r"\b(?:pretend|act|respond)\s+(?:to\s+be|as\s+if|as|like)\b[^.!?]*\b(?:no|without(?:\s+any)?)\s+(?:restrictions|rules|filters|limits)\b", 0.9),
    ("bypass", r"\b(?:bypass|disable|turn\s+off)\s+(?:your\s+|the\s+|all\s+)?(?:safety|security|content)\s+(?:filters?|rules?|checks?|guidelines?)\b", 0.9),
    ("privileged_mode", r"\b(?:developer|god|debug|admin)\s+mode\s+(?:on|enabled|activated)\b", 0.85),
    ("new_instructions", r"\bnew\s+instructions\s*:", 0.6),
    ("role_switch", r"\byou\s+are\s+now\b", 0.5),
)

# Score of a recognised span; a phone without any separator is only a weak hit.
SPAN_SCORES = {
    "EMAIL_ADDRESS": 0.95,
    "PHONE_NUMBER": 0.4,
    "US_SSN": 0.85,
    "CREDIT_CARD": 0.9,
    "PERSON": 0.85,
    "IP_ADDRESS": 0.6,
}
WEAK_SPAN_SCORE = 0.05
BARE_DIGITS_PATTERN = r"^\s?\d+$"
IP_PATTERN = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IP_LIKE_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"

WORD_PATTERN = r"\p{L}+"
